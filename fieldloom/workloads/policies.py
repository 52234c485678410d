"""Policy-like texts made from orders and customers, the same in Spark and in SQL.

Labels stand in one block and their values eight lines below, as in the first
document family.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.workloads.registry import spread, table

SPARK = {"date": "date_format({c}, '{f}')", "money": "format_number(cast({c} as decimal(18,2)) / 100, 2)",
         "dmy": "dd/MM/yyyy", "ymd": "yyMMdd", "div": "({a} div {b})"}
DUCK = {"date": "strftime({c}, '{f}')", "money": "format('{{:,.2f}}', ({c}) / 100.0)",
        "dmy": "%d/%m/%Y", "ymd": "%y%m%d", "div": "({a} // {b})"}


def _line_expressions(d: dict[str, str]) -> list[str]:
    day = d["date"].format(c="o_orderdate", f=d["dmy"])
    next_year = d["date"].format(c="o_orderdate + interval 1 year", f=d["dmy"])
    short = d["date"].format(c="o_orderdate", f=d["ymd"])
    money = lambda c: d["money"].format(c=c)
    return [
        "concat('POLIZA ', o_orderkey)",
        "'INFORMACION DEL ASEGURADO'",
        "concat(upper(replace(c_name, '#', ' ')), case when c_nationkey < 8 then ' S.A. DE C.V.' when c_nationkey < 12 then ' AC' else '' end)",
        f"concat('R.F.C.: ', case when c_nationkey < 12 then concat(substr(c_mktsegment, 1, 3), '-', {short}, '-', 'X', 10 + c_nationkey) "
        f"else concat(substr(c_mktsegment, 1, 4), {short}) end)",
        "concat('Municipio: ', n_name, ' Estado: PUEBLA')",
        "'C.P.:'",
        "cast(1000 + c_custkey % 90000 as varchar(20))",
        "concat('CIUDAD ', n_name)",
        "'PUEBLA'",
        "'DESCRIPCION DEL VEHICULO ASEGURADO'",
        "concat('Tipo: ', case o_orderpriority when '1-URGENT' then 'Camiones-Panel' when '2-HIGH' then 'Motocicletas' "
        "when '3-MEDIUM' then 'Automoviles Nacionales' when '5-LOW' then 'Otro tipo' else 'Tractocamion' end)",
        "concat('Motor:KA', lpad(cast(o_orderkey as varchar(20)), 8, '0'), ' Color: Placas:', case o_orderstatus when 'F' then 'ABC' when 'O' then 'XY' else 'Q' end, "
        "100 + o_orderkey % 900)",
        f"concat('VIGENCIA ', {day}, ' AL ', {next_year})",
        f"concat('EMITIDA ', {day})",
        "'PRIMA NETA'",
        "'TASA FINANCIAMIENTO'",
        "'GASTOS POR EXPEDICION'",
        "'SUBTOTAL'",
        "'I.V.A.'",
        "'IMPORTE TOTAL'",
        "'FORMA DE PAGO'",
        "'MONEDA'",
        money("net"),
        f"concat('-', {money('discount')})",
        money("fees"),
        money("subtotal + case o_orderstatus when 'P' then 100 else 0 end"),
        money("tax"),
        money("subtotal + tax + case o_orderstatus when 'F' then 5 else 0 end"),
        "case o_orderpriority when '1-URGENT' then 'CONTADO' when '2-HIGH' then 'SEMESTRAL' when '3-MEDIUM' then 'ANUAL' when '5-LOW' then 'MENSUAL' else 'OTRA' end",
        "case when c_nationkey < 20 then 'PESOS' else 'USD' end",
        "'Agente:'",
        "'CIUDAD DE MEXICO'",
        "concat('AGENTE ', c_mktsegment)",
        "cast(1000 + c_custkey as varchar(20))",
        "'5-46-14-58'",
    ]


def _amounts(d: dict[str, str]) -> str:
    div = lambda a, b: d["div"].format(a=a, b=b)
    return f"""
    SELECT *, {div('subtotal * 16', 100)} AS tax FROM (
      SELECT *, net - discount + fees AS subtotal FROM (
        SELECT o.*, c.*, n_name, cast(round(o_totalprice * 100) as bigint) AS net,
               {div('cast(round(o_totalprice * 100) as bigint)', 50)} AS discount, 87000 AS fees
        FROM orders o JOIN customer c ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey) a) b"""


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
_PRODUCT = "cast(case c_mktsegment " + " ".join(f"when '{s}' then {i}" for i, s in enumerate(SEGMENTS, 1)) + " end as bigint)"


def _statement(d: dict[str, str]) -> str:
    return f"""
    SELECT o_orderkey AS doc_id, c_nationkey AS nation_id, c_mktsegment AS segment, {_PRODUCT} AS product_id, o_orderpriority AS priority, o_orderstatus AS status,
           concat_ws(chr(10), {', '.join(_line_expressions(d))}) AS text
    FROM ({_amounts(d)}) t"""


def policies(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, nation_id, segment, product_id, priority, status, text)."""
    return spark.sql(
        _statement(SPARK).replace("FROM orders o", "FROM {orders} o").replace("JOIN customer c", "JOIN {customer} c").replace("JOIN nation ON", "JOIN {nation} ON"),
        orders=spread(table(spark, folder, "orders")), customer=table(spark, folder, "customer"), nation=table(spark, folder, "nation"),
    )


def with_lines(docs: DataFrame) -> DataFrame:
    from fieldloom.functions import text as tx

    return docs.withColumn("lines", tx.lines(F.col("text")))


POLICY = f"policy AS ({_statement(DUCK)})"
LINES = (
    POLICY + ",\nlines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, "
    "unnest(range(len(string_split(text, chr(10))))) AS no FROM policy)"
)
WITH_POLICY, WITH_LINES = f"WITH {POLICY}", f"WITH {LINES}"
