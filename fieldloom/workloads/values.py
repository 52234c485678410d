"""Validators, amounts, normalisation, model answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldloom.field_sets import FIELD_LABELS, field_label
from fieldloom.functions import amounts, checks
from fieldloom.functions import text as tx
from fieldloom.functions.regex import compiles, first_match, keep_compilable
from fieldloom.operators import upkeep
from fieldloom.sources import ingest
from fieldloom.workloads.policies import WITH_LINES, WITH_POLICY, policies, with_lines
from fieldloom.workloads.registry import documents, query, table

TAX = r"R\.F\.C\.: (\S+)"


@query(f"""{WITH_LINES}, v AS (SELECT doc_id, replace(regexp_extract(text, 'R\\.F\\.C\\.: (\\S+)', 1), '-', '') AS tax_id, regexp_extract(text, 'Placas:(\\w+)', 1) AS plate,
  split_part(text, chr(10), 7) AS code FROM policy)
SELECT doc_id, CASE WHEN regexp_matches(tax_id, '^[A-Z]{{4}}[0-9]{{6}}') THEN 'Persona Física' WHEN regexp_matches(tax_id, '^[A-Z]{{3}}[0-9]{{6}}') THEN 'Persona Moral' END AS person,
  length(plate) IN (6, 7) AND regexp_full_match(plate, '[A-Z]{{2,3}}\\d{{3,4}}|[A-Z]{{4}}\\d{{2,3}}|\\d{{2,3}}[A-Z]{{3,4}}|[A-Z]\\d{{2}}[A-Z]{{3}}|[A-Z]{{2}}\\d{{2}}[A-Z]{{2}}') AS plate_ok,
  CASE WHEN length(plate) = 6 THEN left(plate, 3) || '-' || substr(plate, 4) ELSE plate END AS plate, regexp_full_match(code, '\\d{{4,5}}') AS code_ok, lpad(code, 5, '0') AS code FROM v""")
def validate_ids(spark, folder):
    """Tax id, plate and postal code of each policy."""
    t = F.col("text")
    staged = with_lines(policies(spark, folder)).select(
        "doc_id", tx.compact_tax_id(first_match(t, TAX, 1)).alias("tax_id"), first_match(t, r"Placas:(\w+)", 1).alias("plate"), F.get("lines", F.lit(6)).alias("code")
    )
    return staged.select(
        "doc_id", checks.person_type(F.col("tax_id")).alias("person"), checks.is_plate(F.col("plate")).alias("plate_ok"),
        tx.format_plate(F.col("plate")).alias("plate"), checks.is_postal_code(F.col("code")).alias("code_ok"), tx.pad_postal_code(F.col("code")).alias("code"),
    )


_NUM = lambda n: f"CAST(replace(string_split(text, chr(10))[{n}], ',', '') AS DECIMAL(18,2))"


@query(f"""{WITH_POLICY}, a AS (SELECT doc_id, {_NUM(23)} AS net, -{_NUM(24)} AS discount, {_NUM(25)} AS fees, {_NUM(27)} AS tax, {_NUM(28)} AS total,
  string_split(text, chr(10))[26] AS printed FROM policy),
c AS (SELECT *, net - discount + fees AS made FROM a)
SELECT doc_id, format('{{:,.2f}}', CAST(made AS DOUBLE)) AS computed, printed,
  CASE WHEN abs(made - (total - tax)) <= 0.01 THEN format('{{:,.2f}}', CAST(made AS DOUBLE)) ELSE printed END AS value,
  CASE WHEN abs(made - (total - tax)) <= 0.01 THEN 'checked' ELSE 'printed' END AS status FROM c""")
def subtotal_reconcile(spark, folder):
    """Computed subtotal checked against total and tax."""
    line = lambda n: F.get("lines", F.lit(n))
    staged = with_lines(policies(spark, folder)).select(
        "doc_id", line(22).alias("net"), F.ltrim(line(23), F.lit("-")).alias("discount"), line(24).alias("fees"), line(25).alias("printed"),
        line(26).alias("tax"), line(27).alias("total"),
    )
    staged = staged.withColumn("computed", amounts.subtotal(F.col("net"), F.col("discount"), F.lit(None).cast("string"), F.col("fees")))
    chosen = amounts.reconcile(F.col("computed"), F.col("printed"), F.col("total"), F.col("tax"))
    return staged.select("doc_id", "computed", "printed", chosen.alias("r")).select("doc_id", "computed", "printed", "r.*")


@query("""WITH t AS (SELECT l_orderkey, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS net,
  CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT) * CAST(round(l_discount * 100) AS BIGINT) // 100) AS BIGINT) AS discount FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey AS doc_id, format('{:,.2f}', (net - discount) / 100.0) AS subtotal FROM t""")
def lineitem_subtotal(spark, folder):
    """Subtotal of each order from its printed line amounts."""
    cents = lambda c: F.round(F.col(c) * 100).cast("bigint")
    net = F.sum(cents("l_extendedprice"))
    discount = F.sum(F.floor(cents("l_extendedprice") * cents("l_discount") / 100).cast("bigint"))
    sums = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(net.alias("net"), discount.alias("discount"))
    text = lambda c: F.format_number((F.col(c).cast("decimal(20,0)") / 100).cast(amounts.MONEY), 2)
    none = F.lit(None).cast("string")
    return sums.select(F.col("l_orderkey").alias("doc_id"), amounts.subtotal(text("net"), text("discount"), none, none).alias("subtotal"))


@query(f"""{WITH_POLICY}, v AS (SELECT doc_id, CASE WHEN status <> 'P' THEN replace(regexp_extract(text, 'R\\.F\\.C\\.: (\\S+)', 1), '-', '') END AS tax_id, split_part(text, chr(10), 3) AS name FROM policy),
r AS (SELECT *, CASE WHEN regexp_matches(tax_id, '^[A-Z]{{4}}[0-9]{{6}}') THEN 'Persona Física' WHEN regexp_matches(tax_id, '^[A-Z]{{3}}[0-9]{{6}}') THEN 'Persona Moral' END AS p FROM v)
SELECT doc_id, regexp_matches(replace(name, '.', ''), '\\b(SA( DE CV)?|AC)\\b') AS legal_name,
  coalesce(p, CASE WHEN regexp_matches(replace(name, '.', ''), '\\b(SA( DE CV)?|AC)\\b') THEN 'Persona Moral' END) AS label,
  CASE p WHEN 'Persona Física' THEN '0' WHEN 'Persona Moral' THEN '1' END AS code FROM r""")
def entity_derivation(spark, folder):
    """Person type by tax id, company form in the name as back-up."""
    tax = F.when(F.col("status") != "P", first_match(F.col("text"), TAX, 1))
    staged = with_lines(policies(spark, folder)).select("doc_id", tx.compact_tax_id(tax).alias("tax_id"), F.get("lines", F.lit(2)).alias("name"))
    none = F.lit(None).cast("string")
    return staged.select(
        "doc_id", checks.is_legal_person_name(F.col("name")).alias("legal_name"),
        amounts.derive_person_type(none, F.col("tax_id"), F.col("name")).alias("label"),
        amounts.derive_person_type(none, F.col("tax_id"), F.col("name"), "code").alias("code"),
    )


@query(f"""{WITH_POLICY}, v AS (SELECT doc_id, segment, split_part(text, chr(10), 3) AS name, regexp_extract(text, 'R\\.F\\.C\\.: (\\S+)', 1) AS tax_id, regexp_extract(text, 'Placas:(\\w+)', 1) AS plate,
  split_part(text, chr(10), 11) AS vt FROM policy)
SELECT doc_id, replace(name, 'S.A. DE C.V.', 'SA DE CV') AS form, replace(tax_id, '-', '') AS tax_id, upper(replace('Dirección ' || name, 'ó', 'O')) AS plain,
  lower(regexp_replace('  ' || name || chr(9) || ' X ', '\\s+', ' ', 'g')).trim() AS squeezed,
  CASE WHEN length(plate) = 6 THEN left(plate, 3) || '-' || substr(plate, 4) ELSE plate END AS plate,
  CASE WHEN segment = 'BUILDING' THEN 'VEHÍCULOS RESIDENTES' ELSE segment END AS origin,
  CASE WHEN vt LIKE '%Motocicletas' THEN 'Motocicletas' WHEN vt LIKE '%Panel' OR vt LIKE '%Tractocamion' THEN 'Camiones' END AS product FROM v""")
def text_normalise(spark, folder):
    """Company form, tax id, accents, white space, plate, origin, product of a type."""
    t = F.col("text")
    staged = with_lines(policies(spark, folder)).select(
        "doc_id", "segment", F.get("lines", F.lit(2)).alias("name"), first_match(t, TAX, 1).alias("tax_id"), first_match(t, r"Placas:(\w+)", 1).alias("plate"),
        first_match(t, r"Tipo:\s*(.+)", 1).alias("kind"),
    )
    name = F.col("name")
    raw_origin = F.when(F.col("segment") == "BUILDING", F.lit(" vehículos résidentes")).otherwise(F.col("segment"))
    return staged.select(
        "doc_id", tx.plain_company_form(name).alias("form"), tx.compact_tax_id(F.col("tax_id")).alias("tax_id"),
        tx.upper_plain(F.concat(F.lit("Dirección "), name)).alias("plain"),
        F.lower(tx.squeeze(F.concat(F.lit("  "), name, F.lit("\t X ")))).alias("squeezed"), tx.format_plate(F.col("plate")).alias("plate"),
        tx.vehicle_origin(raw_origin).alias("origin"), tx.product_of_type(F.col("kind")).alias("product"),
    )


@query(f"""{WITH_POLICY}, v AS (SELECT doc_id, split_part(text, chr(10), 3) AS name FROM policy)
SELECT doc_id, 'Customer ' || regexp_extract(name, '\\d+') || CASE WHEN name LIKE '%S.A. DE C.V.' THEN ' S.A. De C.V.' WHEN name LIKE '% AC' THEN ' Ac' ELSE '' END AS title FROM v""")
def title_case(spark, folder):
    """Names with a capital after every non-letter."""
    return with_lines(policies(spark, folder)).select("doc_id", tx.title_case(F.get("lines", F.lit(2))).alias("title"))


@query(f"""{WITH_POLICY}, v AS (SELECT doc_id, split_part(text, chr(10), 29) AS pay, status FROM policy),
w AS (SELECT *, CASE status WHEN 'P' THEN ' No Encontrado ' WHEN 'O' THEN 'S/N' ELSE pay END AS raw FROM v)
SELECT doc_id, CASE WHEN status = 'F' THEN raw END AS value, pay IN ('CONTADO', 'SEMESTRAL', 'TRIMESTRAL', 'MENSUAL', 'ANUAL') AS known,
  contains(upper('Aviso de privacidad integral ' || pay), 'AVISO DE PRIVACIDAD INTEGRAL') AND status <> 'O' AS legal FROM w""")
def sentinel_filter(spark, folder):
    """Texts that mean nothing, listed values, legal phrases."""
    staged = with_lines(policies(spark, folder)).select("doc_id", "status", F.get("lines", F.lit(28)).alias("pay"))
    raw = F.when(F.col("status") == "P", " No Encontrado ").when(F.col("status") == "O", "S/N").otherwise(F.col("pay"))
    phrase = F.when(F.col("status") == "O", F.col("pay")).otherwise(F.concat(F.lit("Aviso de privacidad integral "), "pay"))
    return staged.select("doc_id", checks.real_value(raw).alias("value"), F.col("pay").isin(*checks.PAYMENT_FORMS).alias("known"),
                         checks.has_legal_phrase(phrase).alias("legal"))


@query(f"""{WITH_POLICY}, v AS (SELECT doc_id, string_split(text, chr(10)) AS l, text FROM policy)
SELECT doc_id, regexp_matches(l[24], '^-?\\d{{1,3}}(,\\d{{3}})*\\.\\d{{2}}') AS money_ok, lower(l[3]) IN ('permiso', 's/n') AS plate_word,
  length(replace(regexp_extract(text, 'R\\.F\\.C\\.: (\\S+)', 1), '-', '')) IN (10, 12, 13) AS tax_ok,
  contains(upper(text), 'POLIZA') AND regexp_matches(upper(text), 'PLACAS|COBERTURA') AS gate,
  NOT regexp_matches(l[3], 'RFC|ESTADO') AND regexp_matches(l[3], 'S\\.?A\\.?\\s+DE\\s+C\\.?V') AS name_ok,
  CASE WHEN contains(text, 'SEMESTRAL') THEN l[28] ELSE l[23] END AS net,
  strftime(strptime(regexp_extract(text, 'EMITIDA (\\S+)', 1), '%d/%m/%Y'), '%Y-%m-%d') AS issued, CAST(CAST(replace(l[28], ',', '') AS DECIMAL(18,2)) AS VARCHAR) AS total,
  CASE WHEN regexp_matches(l[34], '^\\d{{4,6}}$') THEN l[34] END AS agent_key FROM v""")
def id_and_money_checks(spark, folder):
    """Amount shapes, plate words, tax id lengths, gate, name test, alternative net amount, typed views."""
    line = lambda n: F.get("lines", F.lit(n))
    t = F.col("text")
    staged = with_lines(policies(spark, folder))
    key = line(33)
    return staged.select(
        "doc_id", checks.is_amount(line(23)).alias("money_ok"), checks.is_plate_word(line(2)).alias("plate_word"),
        checks.is_tax_id_candidate(tx.compact_tax_id(first_match(t, TAX, 1))).alias("tax_ok"),
        checks.company_gate(F.upper(t), "POLIZA", ["PLACAS", "COBERTURA"]).alias("gate"), checks.looks_like_name(line(2)).alias("name_ok"),
        amounts.discounted_net(t, line(22), line(27), "SEMESTRAL").alias("net"), amounts.to_date(first_match(t, r"EMITIDA (\S+)", 1)).cast("string").alias("issued"),
        amounts.to_money(line(27)).cast("string").alias("total"), F.when(checks.is_agent_key(key), key).alias("agent_key"),
    )


@query("""WITH p AS (SELECT p_brand, list_distinct(list(split_part(p_name, ' ', 1))) AS a, list(DISTINCT p_type) AS b FROM part GROUP BY p_brand)
SELECT p_brand, list_sort(list_distinct(list_concat(a, b))) AS merged, len(list_distinct(list_concat(a, b))) AS n FROM p""")
def array_merge_patterns(spark, folder):
    """Lists of patterns merged without repeats, broken ones left out."""
    lists = table(spark, folder, "part").groupBy("p_brand").agg(F.collect_set(F.split("p_name", " ")[0]).alias("a"), F.collect_set("p_type").alias("b"))
    merged = upkeep.merge_patterns(F.col("a"), keep_compilable(F.concat("b", F.array(F.lit("(broken")))))
    return lists.select("p_brand", F.array_sort(merged).alias("merged"), F.size(merged).cast("bigint").alias("n"))


@query("""SELECT p_partkey, p_size > 10 AS valid FROM part""")
def pattern_check(spark, folder):
    """Patterns that compile; some are broken on purpose."""
    pattern = F.when(F.col("p_size") > 10, F.col("p_name")).otherwise(F.concat(F.lit("["), "p_name"))
    return table(spark, folder, "part").select("p_partkey", compiles(pattern).alias("valid"))


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS product_id, CASE WHEN event_type = 'error' THEN NULL ELSE value / 100 END AS confidence,
  event_type = 'error' AS unreadable FROM (SELECT * REPLACE (CASE WHEN event_type = 'error' THEN NULL ELSE props END AS props) FROM events)""")
def model_json(spark, folder):
    """Model answers in code fences, inside other text, and broken."""
    body = F.concat(F.lit('{"product_id": '), F.get_json_object("props", "$.k"), F.lit(', "confidence": '), F.col("value") / 100, F.lit("}"))
    e = F.col("event_type")
    raw = (
        F.when(e == "error", F.concat(F.lit("no answer {"), F.col("props"), F.lit(" oops")))
        .when(e == "click", F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(e == "view", F.concat(F.lit("The answer is "), body, F.lit(" as asked.")))
        .otherwise(body)
    )
    answers = table(spark, folder, "events").select("event_id", raw.alias("raw"))
    return ingest.parse_answers(answers).select("event_id", "product_id", "confidence", "unreadable")


@query("""SELECT event_id, CASE WHEN event_type = 'error' THEN 'old' ELSE 'documento' END AS field,
  CASE WHEN event_type = 'click' THEN ['desde', 'k'] WHEN event_type = 'error' THEN ['k'] ELSE ['documento', 'k'] END AS keys FROM events""")
def field_rename(spark, folder):
    """Current field names in a column and as keys of a record."""
    e = F.col("event_type")
    old = F.when(e == "error", "old").when(e == "view", "numero_poliza").otherwise("documento")
    key = F.when(e == "click", "inicio_vigencia").when(e != "error", "numero_poliza")
    record = F.from_json("props", "map<string,string>")
    renamed = F.when(key.isNotNull(), F.map_concat(record, F.create_map(F.coalesce(key, F.lit("-")), F.lit("1")))).otherwise(record)
    staged = table(spark, folder, "events").select("event_id", old.alias("field"), renamed.alias("record"))
    done = upkeep.rename_fields(staged, "field")
    return done.select("event_id", "field", F.array_sort(F.map_keys(upkeep.rename_map_keys(F.col("record")))).alias("keys"))


@query("""SELECT 'events' AS "table", CASE WHEN event_type = 'view' THEN 'numero_poliza' ELSE 'fin_vigencia' END AS old_name, count(*) AS n
FROM events WHERE event_type IN ('view', 'click') GROUP BY event_type UNION ALL SELECT 'orders', 'gastos_expedicion', count(*) FROM orders WHERE o_orderstatus = 'F'""")
def rename_report(spark, folder):
    """Rows of each table that a rename touches."""
    e = F.col("event_type")
    events = table(spark, folder, "events").select(F.when(e == "view", "numero_poliza").when(e == "click", "fin_vigencia").otherwise("rfc").alias("name"))
    orders = table(spark, folder, "orders").select(F.when(F.col("o_orderstatus") == "F", "gastos_expedicion").otherwise("derechos").alias("name"))
    return upkeep.rename_report({"events": (events, "name"), "orders": (orders, "name")})


@query("""WITH t AS (SELECT doc_id, source, text, n_chars FROM documents)
SELECT source, count(*) FILTER (n_chars >= 200 AND n_chars <= 5000) AS accepted, count(*) FILTER (reason = 'only PDF files are accepted') AS not_pdf,
  count(*) FILTER (reason = 'file is larger than 15 MB') AS too_large, count(*) FILTER (reason LIKE 'more than%') AS request_too_long FROM (
  SELECT *, CASE WHEN count(*) OVER (PARTITION BY source) > 50 THEN 'more than 50 files in the request' WHEN n_chars < 200 THEN 'only PDF files are accepted'
    WHEN n_chars > 5000 THEN 'file is larger than 15 MB' END AS reason FROM t) WHERE true GROUP BY source""")
def admit_files(spark, folder):
    """Admission of files per request (source): number, name and size."""
    files = documents(spark, folder).select(
        "source", F.concat("doc_id", F.when(F.col("n_chars") < 200, ".txt").otherwise(".PDF")).alias("name"),
        F.when(F.col("n_chars") > 5000, 16 * 1024 * 1024).otherwise(F.col("n_chars")).alias("size"),
    )
    reason = F.coalesce("reject_reason", F.lit(""))
    return ingest.admit(files, "source").groupBy("source").agg(
        F.count_if(F.col("reject_reason").isNull()).alias("accepted"), F.count_if(reason == "only PDF files are accepted").alias("not_pdf"),
        F.count_if(reason == "file is larger than 15 MB").alias("too_large"), F.count_if(reason.startswith("more than")).alias("request_too_long"),
    )


@query("""SELECT source, count(*) FILTER (n_chars < 200) AS quarantined, count(*) FILTER (n_chars >= 200 AND n_chars <= 5000) AS accepted FROM documents GROUP BY source""")
def quarantine_split(spark, folder):
    """Accepted and quarantined files, without the limit per request."""
    files = documents(spark, folder).select(
        "source", F.concat("doc_id", F.when(F.col("n_chars") < 200, ".txt").otherwise(".pdf")).alias("name"),
        F.when(F.col("n_chars") > 5000, 16 * 1024 * 1024).otherwise(F.col("n_chars")).alias("size"),
    )
    admitted = ingest.admit(files)
    bad = ingest.quarantine(admitted).filter("reject_reason like 'only%'").select("source", F.lit(1).alias("q"), F.lit(0).alias("a"))
    good = ingest.accepted(admitted).select("source", F.lit(0).alias("q"), F.lit(1).alias("a"))
    return bad.unionByName(good).groupBy("source").agg(F.sum("q").alias("quarantined"), F.sum("a").alias("accepted"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 < 2 THEN 'COL ' || n_name END AS colony, CASE WHEN c_custkey % 3 < 2 THEN c_mktsegment END AS municipality,
  CASE WHEN c_custkey % 3 < 2 THEN CAST(1000 + c_custkey % 90000 AS VARCHAR) END AS postal_code FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def address_parts(spark, folder):
    """Parts of one-line addresses: two spellings of the code, one line without it."""
    code = (F.lit(1000) + F.col("c_custkey") % 90000).cast("string")
    tail = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit(", C.P. "), code)).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit(", cp"), code, F.lit(" "))).otherwise("")
    line = F.concat(F.lit("CALLE "), "c_custkey", F.lit(", COL "), "n_name", F.lit(", "), "c_mktsegment", F.lit(", PUEBLA"), tail)
    rows = table(spark, folder, "customer").join(F.broadcast(table(spark, folder, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select("c_custkey", tx.address_parts(line).alias("a")).select("c_custkey", "a.*")


_NAMED = ["documento", "rfc", "prima_neta", "sub_total", "otro_campo"]


@query(f"""SELECT o_orderkey, coalesce(MAP {{{', '.join(f"'{f}': '{FIELD_LABELS[f]}'" for f in _NAMED if f in FIELD_LABELS)}}}[f], f) AS label
FROM (SELECT o_orderkey, ({_NAMED})[o_orderkey % {len(_NAMED)} + 1] AS f FROM orders)""")
def field_labels(spark, folder):
    """Readable name of a field, its own name where there is none."""
    name = F.element_at(F.array(*map(F.lit, _NAMED)), (F.col("o_orderkey") % len(_NAMED) + 1).cast("int"))
    return table(spark, folder, "orders").select("o_orderkey", field_label(name).alias("label"))


@query("""SELECT doc_id, lang AS field, left(text, 1000) AS value, true AS is_auto, 'regla' AS method FROM documents WHERE coalesce(text, '') <> ''""")
def automatic_labels_cut(spark, folder):
    """Labels from whole texts keep their first thousand characters."""
    long_fields = documents(spark, folder).select("doc_id", F.col("lang").alias("field"), F.col("text").alias("value"), F.lit("regla").alias("method"))
    return upkeep.automatic_labels(long_fields)
