"""Location strategies on the policy texts and votes."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldloom.functions import checks, votes
from fieldloom.functions import text as tx
from fieldloom.functions.regex import cascade, find_all, first_match
from fieldloom.operators import locate as loc
from fieldloom.operators import voting
from fieldloom.plans.recipes import Doc, Recipe, prepare_documents, run_recipe
from fieldloom.workloads.policies import WITH_LINES, WITH_POLICY, policies, with_lines
from fieldloom.workloads.registry import documents, query, table

CENTS = r"-?\d{1,3}(?:,\d{3})*\.\d{2}"


def _docs(spark, folder):
    return with_lines(policies(spark, folder).select("doc_id", "text"))


@query(f"""{WITH_LINES} SELECT a.doc_id, regexp_extract(v.line, '{CENTS}') AS net, regexp_extract(w.line, '{CENTS}') AS discount
FROM lines a JOIN lines v ON v.doc_id = a.doc_id AND v.no = a.no + 8 AND a.line = 'PRIMA NETA' JOIN lines w ON w.doc_id = a.doc_id AND w.no = a.no + 9""")
def label_offset_value(spark, folder):
    """Amounts eight lines below their labels."""
    pick = loc.found(CENTS)
    return _docs(spark, folder).select(
        "doc_id", loc.label_offset(F.col("lines"), loc.has("PRIMA NETA"), [8, 1], pick).alias("net"),
        loc.label_offset(F.col("lines"), loc.has("TASA FINANCIAMIENTO"), [100, 8], pick, first_only=False).alias("discount"),
    )


@query(f"""{WITH_LINES} SELECT doc_id, line, lead(line, 1) OVER w AS next_line, lead(line, 8) OVER w AS value FROM lines
WINDOW w AS (PARTITION BY doc_id ORDER BY no) QUALIFY line IN ('PRIMA NETA', 'I.V.A.')""")
def label_offset_table(spark, folder):
    """The same lead by k lines on the line table, each line with those at its offsets."""
    offsets = {"next_line": 1, "value": 8}
    lines = loc.line_table(policies(spark, folder).select("doc_id", "text"), ahead=list(offsets.values()))
    return loc.table_offsets(lines, F.col("line").isin("PRIMA NETA", "I.V.A."), offsets)


@query(f"""{WITH_LINES}, hit AS (SELECT a.doc_id, v.no, regexp_extract(v.line, '{CENTS}') AS v FROM lines a JOIN lines v
  ON v.doc_id = a.doc_id AND a.line = 'IMPORTE TOTAL' AND v.no BETWEEN a.no + 1 AND a.no + 35)
SELECT doc_id, arg_max(v, no) AS last_amount, arg_min(v, no) AS first_amount FROM hit WHERE v <> '' GROUP BY doc_id""")
def window_last_amount(spark, folder):
    """First and last amount in a window after a label."""
    pick = loc.found(CENTS)
    window = lambda which: loc.label_window(F.col("lines"), loc.has("IMPORTE TOTAL", "PRIMA TOTAL"), 1, 35, pick, which)
    return _docs(spark, folder).select("doc_id", window("last").alias("last_amount"), window("first").alias("first_amount"))


@query(f"""{WITH_LINES}, a AS (SELECT doc_id, no FROM lines WHERE line LIKE 'Municipio%'),
seg AS (SELECT l.* FROM lines l JOIN a USING (doc_id) WHERE l.no BETWEEN a.no AND a.no + 14),
s AS (SELECT doc_id, min(no) AS stop FROM seg WHERE line = 'PUEBLA' GROUP BY doc_id),
c AS (SELECT doc_id, max(no) AS start FROM seg JOIN s USING (doc_id) WHERE no < stop AND regexp_full_match(line, '\\d{{4,5}}') GROUP BY doc_id)
SELECT doc_id, string_agg(line, ' ' ORDER BY no) FILTER (no > start AND no < stop) AS place FROM seg LEFT JOIN s USING (doc_id) LEFT JOIN c USING (doc_id) GROUP BY doc_id""")
def between_anchors(spark, folder):
    """Lines between the postal code and the state."""
    place = loc.between_anchors(F.col("lines"), loc.matches(r"\bMunicipio\b"), checks.is_postal_code, checks.is_state)
    return _docs(spark, folder).select("doc_id", place.alias("place"))


@query(f"""{WITH_LINES}, b AS (SELECT doc_id, min(no) FILTER (line LIKE 'DESCRIPCION DEL VEHICULO%') AS stop, max(no) FILTER (line LIKE 'INFORMACION DEL ASEG%') AS start
  FROM lines GROUP BY doc_id)
SELECT doc_id, count(*) AS n_lines, max(regexp_extract(line, 'R\\.F\\.C\\.: (.*)', 1)) AS tax_id, arg_max(line, no) AS last_line,
  max(regexp_extract(text, '(?s)ASEGURADO\\n(.*?)\\nMunicipio', 1)) AS head
FROM lines JOIN b USING (doc_id) JOIN policy USING (doc_id) WHERE no >= start AND no < stop GROUP BY doc_id""")
def section_slice_value(spark, folder):
    """Values inside a section of lines and inside a block of text."""
    block = loc.section_lines(F.col("lines"), loc.has("INFORMACION DEL ASEGURADO"), loc.has("DESCRIPCION DEL VEHICULO ASEGURADO"))
    staged = _docs(spark, folder).withColumn("block", block)
    b = F.col("block")
    return staged.select(
        "doc_id", F.size(b).cast("bigint").alias("n_lines"), loc.label_inline(b, r"R\.F\.C\.: (.*)").alias("tax_id"),
        loc.from_block_end(b, 1).alias("last_line"), loc.section(F.col("text"), r"ASEGURADO\n", r"\nMunicipio").alias("head"),
    )


@query(f"""{WITH_LINES}, v AS (SELECT doc_id, regexp_extract(text, 'Motor:(\\w+)', 1) AS motor FROM policy),
m AS (SELECT doc_id, min(no) AS no FROM lines JOIN v USING (doc_id) WHERE contains(line, motor) GROUP BY doc_id)
SELECT m.doc_id, a.line AS after, b.line AS before FROM m LEFT JOIN lines a ON a.doc_id = m.doc_id AND a.no = m.no + 1 LEFT JOIN lines b ON b.doc_id = m.doc_id AND b.no = m.no - 1""")
def relative_to_field(spark, folder):
    """Lines around the line that holds another field's value."""
    staged = _docs(spark, folder).withColumn("motor", first_match(F.col("text"), r"Motor:(\w+)", 1))
    m = F.col("motor")
    return staged.select("doc_id", loc.relative_to(F.col("lines"), m, 1).alias("after"), loc.line_before(F.col("lines"), m).alias("before"))


@query(f"""{WITH_LINES}, a AS (SELECT doc_id, no FROM lines WHERE line = 'C.P.:')
SELECT doc_id, (SELECT arg_min(l.line, l.no) FROM lines l WHERE l.doc_id = a.doc_id AND l.no BETWEEN a.no + 1 AND a.no + 4
  AND EXISTS (FROM lines c WHERE c.doc_id = l.doc_id AND c.no BETWEEN l.no - 2 AND l.no - 1 AND regexp_full_match(c.line, '\\d{{4,5}}'))) AS value,
  (SELECT line FROM lines l WHERE l.doc_id = a.doc_id AND l.no = 33) AS penultimate FROM a""")
def context_window(spark, folder):
    """First line of a window that has the wanted context, and a checked last line but one."""
    code = lambda line: checks.is_postal_code(line)
    return _docs(spark, folder).select(
        "doc_id", loc.context_window(F.col("lines"), loc.matches(r"\bC\.P\.:"), 1, 4, 2, code).alias("value"),
        loc.penultimate_line(F.col("lines"), 3, loc.has("AGENTE")).alias("penultimate"),
    )


@query(f"""{WITH_LINES} SELECT a.doc_id, v.line AS currency, CASE WHEN regexp_full_match(s.line, '-?[\\d,]+\\.\\d{{2}}') THEN s.line END AS subtotal
FROM lines a JOIN lines v ON v.doc_id = a.doc_id AND a.line = 'MONEDA' AND v.no = a.no + 8 JOIN lines t ON t.doc_id = a.doc_id AND lower(t.line) = 'subtotal'
JOIN lines s ON s.doc_id = a.doc_id AND s.no = t.no + 8""")
def exact_label_line(spark, folder):
    """Values below lines that equal a label."""
    amount = loc.whole(lambda v: checks.full_match(v, r"-?[\d,]+\.\d{2}"))
    return _docs(spark, folder).select(
        "doc_id", loc.label_offset(F.col("lines"), loc.equals("MONEDA"), [8], loc.whole()).alias("currency"),
        loc.label_offset(F.col("lines"), loc.equals("subtotal", F.lower), [8], amount).alias("subtotal"),
    )


@query(f"""{WITH_LINES}, pay AS (SELECT doc_id, line FROM lines WHERE no = 28),
words AS (SELECT doc_id, unnest(['CONTADO', 'SEMESTRAL', 'TRIMESTRAL', 'MENSUAL', 'ANUAL']) AS w, unnest(range(5)) AS i, text FROM policy),
n AS (SELECT doc_id, arg_min(w, -10 * ((length(text) - length(replace(text, w, ''))) // length(w)) + i) AS best,
  max((length(text) - length(replace(text, w, ''))) // length(w)) AS hits FROM words GROUP BY doc_id),
age AS (SELECT doc_id, line AS agent_key FROM lines WHERE no = 33)
SELECT doc_id, CASE WHEN contains(text, ' AC') THEN 'ASOCIACION' WHEN line <> 'OTRA' THEN line WHEN hits > 0 THEN best ELSE 'SIN DATO' END AS payment,
  agent_key, 'AGENTE ' || segment AS agent_name, CASE WHEN agent_key NOT IN ('1001', '1002') THEN agent_key END AS other_key
FROM policy JOIN pay USING (doc_id) JOIN n USING (doc_id) JOIN age USING (doc_id)""")
def strategy_cascade(spark, folder):
    """Constant, listed value at an offset, vote, default; and the numbered agent block."""
    value = loc.first_of(
        loc.constant_if(F.contains("text", F.lit(" AC")), "ASOCIACION"),
        loc.label_offset(F.col("lines"), loc.has("FORMA DE PAGO"), [8], loc.whole(lambda v: v.isin(*checks.PAYMENT_FORMS)), first_only=False),
        votes.word_vote(F.col("text"), checks.PAYMENT_FORMS), default="SIN DATO",
    )
    block = loc.numbered_block(F.col("text"), "Agente:", checks.is_agent_key)
    staged = _docs(spark, folder).withColumn("agent", block)
    return staged.select("doc_id", value.alias("payment"), F.col("agent.key").alias("agent_key"), F.col("agent.name").alias("agent_name"),
                         loc.without(F.col("agent.key"), ["1001", "1002"]).alias("other_key"))


@query(f"""{WITH_LINES}, c AS (SELECT doc_id, v.line AS code, 1 AS src FROM lines a JOIN lines v USING (doc_id) WHERE a.line = 'C.P.:' AND v.no = a.no + 1
  UNION ALL SELECT doc_id, v.line, 2 FROM lines a JOIN lines v USING (doc_id) WHERE a.line = 'Agente:' AND v.no = a.no + 3
  UNION ALL SELECT doc_id, line, 3 FROM lines WHERE regexp_full_match(line, '\\d{{4,5}}')),
n AS (SELECT doc_id, code, count(*) AS n, min(src) AS s, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, min(src)) AS rn FROM c GROUP BY doc_id, code)
SELECT doc_id, lpad(code, 5, '0') AS code FROM n WHERE rn = 1""")
def multi_source_vote(spark, folder):
    """Postal code by vote over three sources."""
    code = loc.whole(checks.is_postal_code)
    one = lambda label, k: F.array(loc.label_offset(F.col("lines"), loc.equals(label), [k], code))
    every = loc.line_matches(F.col("lines"), r"^\d{4,5}$", 0)
    candidates = F.concat(one("C.P.:", 1), one("Agente:", 3), every)
    return _docs(spark, folder).select("doc_id", tx.pad_postal_code(votes.most_common(candidates)).alias("code"))


@query(f"""{WITH_POLICY}, d AS (SELECT doc_id, unnest(regexp_extract_all(text, '\\d{{2}}/\\d{{2}}/\\d{{4}}')) AS v,
  unnest(range(len(regexp_extract_all(text, '\\d{{2}}/\\d{{2}}/\\d{{4}}')))) AS i FROM policy),
n AS (SELECT doc_id, v, count(*) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, min(i)) AS rn FROM d GROUP BY doc_id, v)
SELECT doc_id, max(v) FILTER (rn = 1) AS start_date, max(v) FILTER (rn = 2) AS end_date FROM n GROUP BY doc_id""")
def date_vote(spark, folder):
    """Most frequent date is the start, the next one the end."""
    from fieldloom.plans.family_a import DATES
    from fieldloom.plans.recipes import date_ranking

    ranked = policies(spark, folder).withColumn("top", date_ranking(tx.upper_plain(F.col("text")), DATES))
    return ranked.select("doc_id", F.get("top", F.lit(0)).alias("start_date"), F.get("top", F.lit(1)).alias("end_date"))


@query(f"""{WITH_POLICY} SELECT doc_id, replace(replace(regexp_extract(text, 'R\\.F\\.C\\.: (.*)', 1), '-', ''), ' ', '') AS tax_id,
  'KA' || lpad(CAST(doc_id AS VARCHAR), 8, '0') AS motor, regexp_extract(text, 'Municipio: (.*) Estado', 1) AS place FROM policy""")
def dedicated_recipes(spark, folder):
    """Single recipes of the first document family on the policy texts."""
    import fieldloom.plans.family_a  # noqa: F401  registers the strategies

    staged = prepare_documents(policies(spark, folder).select("doc_id", "text"))
    doc = Doc(F.col("text"), F.col("_upper"), F.col("_plain"), F.col("_lines"), F.col("_ulines"), F.col("spans"))
    run = lambda name, params=None: run_recipe(doc, Recipe("x", name, params or {}))
    return staged.select(
        "doc_id", run("tax_id_vote").alias("tax_id"), run("regex", {"patterns": [r"Motor\s*:\s*([A-Za-z0-9]+?)\s*(?=Color\s*:|Placas\s*:|\n|$)"]}).alias("motor"),
        run("municipality").alias("place"),
    )


@query(f"""{WITH_POLICY} SELECT doc_id, split_part(text, chr(10), 1) AS first_line, len(string_split(text, chr(10))) AS n_lines,
  trim(string_split(split_part(text, chr(10), 11), ':')[2]) AS vehicle_type, instr(text, 'Motor') AS motor_at,
  substr(text, CAST(greatest(1, instr(text, 'Motor') - 10) AS INT), CAST(25 + least(0, instr(text, 'Motor') - 11) AS INT)) AS around,
  regexp_extract_all(text, '\\d{{2}}/\\d{{2}}/\\d{{4}}') AS dates, regexp_extract(text, 'POLIZA (\\d+)', 1) AS number,
  regexp_extract(text, '(?s)Agente:\\n(.*?)\\nAGENTE', 1) AS city FROM policy""")
def text_split_find(spark, folder):
    """Splitting, finding and cutting: lines, after the colon, context, all matches, cascade, block."""
    t = F.col("text")
    staged = _docs(spark, folder)
    return staged.select(
        "doc_id", F.get("lines", F.lit(0)).alias("first_line"), F.size("lines").cast("bigint").alias("n_lines"),
        tx.after_colon(loc.at(F.col("lines"), F.lit(10))).alias("vehicle_type"), F.instr(t, "Motor").cast("bigint").alias("motor_at"),
        tx.context_window(t, F.lit("motor"), 10).alias("around"), find_all(t, r"\d{2}/\d{2}/\d{4}").alias("dates"),
        cascade(t, [r"INCISO (\d+)", r"poliza (\d+)"]).alias("number"), tx.block_between(t, r"Agente:\n", r"\nAGENTE").alias("city"),
    )


# ---- votes over rows --------------------------------------------------------------------

@query("""WITH w AS (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS word, unnest(range(len(string_split(text, ' ')))) AS i FROM conversations),
n AS (SELECT conv_id, word, count(*) AS n, min(turn * 1000000 + i) AS seen FROM w WHERE word <> '' GROUP BY ALL)
SELECT conv_id, word, n FROM n QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, seen) = 1""")
def frequency_vote(spark, folder):
    """Most frequent word of each conversation, ties by first use."""
    words = table(spark, folder, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", " ")).alias("i", "word"))
    return voting.frequency_vote(words.filter("word <> ''").withColumn("at", F.col("turn") * 1_000_000 + F.col("i")), ["conv_id"], "word", "at")


@query("""WITH n AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS seen FROM events GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, seen) AS rn FROM n)
SELECT user_id, max(event_type) FILTER (rn = 1) AS first_value, max(event_type) FILTER (rn = 2) AS second_value FROM r GROUP BY user_id""")
def top2_vote(spark, folder):
    """First and second event type of each user."""
    return voting.top_two_vote(table(spark, folder, "events"), ["user_id"], "event_type", "event_id")


@query("""WITH c AS (SELECT user_id, event_type, event_id, CASE WHEN event_type = 'purchase' AND value > 60 THEN 0 WHEN event_type = 'signup' AND value > 50 THEN 1
  WHEN value > 20 THEN 2 END AS cls FROM events),
n AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS seen, min(cls) AS cls FROM c WHERE cls IS NOT NULL GROUP BY ALL)
SELECT user_id, event_type, n FROM n QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY cls, n DESC, seen) = 1""")
def preference_vote(spark, folder):
    """Most frequent event type of the best class of each user."""
    e, v = F.col("event_type"), F.col("value")
    rank = F.when((e == "purchase") & (v > 60), 0).when((e == "signup") & (v > 50), 1).when(v > 20, 2)
    return voting.preference_vote(table(spark, folder, "events"), ["user_id"], "event_type", "event_id", rank)


@query("""SELECT source, rank, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id DESC) AS rank FROM documents) WHERE rank <= 10""")
def recent_per_product(spark, folder):
    """The ten longest documents of each source (newest texts of each product)."""
    docs = table(spark, folder, "documents")
    top = voting.top_n_per_group(docs, ["source"], [F.col("n_chars"), F.col("doc_id")], 10, ["doc_id", "n_chars"])
    return top.withColumn("rank", F.col("rank").cast("bigint"))


@query("""SELECT doc_id, n_chars, lang FROM documents WHERE source = 'src7' AND text IS NOT NULL ORDER BY n_chars DESC, doc_id DESC LIMIT 10""")
def recent_texts(spark, folder):
    """The ten newest texts of one product."""
    from fieldloom.sources.ingest import recent_texts as newest

    docs = documents(spark, folder).select(
        "doc_id", "lang", "text", F.regexp_extract("source", r"(\d+)", 1).cast("int").alias("product_id"), F.lit(True).alias("successful"),
        F.col("n_chars").alias("created_at"), F.col("doc_id").alias("id"),
    )
    return newest(docs, 7).select("doc_id", F.col("created_at").alias("n_chars"), "lang")


