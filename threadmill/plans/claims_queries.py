"""Statements: overlap, fact checks, near duplicates, topics, vectors, privacy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import facts as FA
from ..functions import text as T
from ..operators import claims as K
from ..operators import similar
from ..operators.current import latest_by
from ..operators.privacy import redacted, stale_groups
from ..storage import settle, spread, table
from .base import SQL_CUR, SQL_EM, current, exchange_messages
from .registry import CORE
from .text_queries import SQL_CLAIM

_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)
_STEM = "CASE WHEN suffix(w, 'ing') AND length(w) >= 6 THEN left(w, -3) WHEN suffix(w, 'ed') AND length(w) >= 5 THEN left(w, -2) WHEN suffix(w, 'es') AND length(w) >= 5 THEN left(w, -2) WHEN suffix(w, 's') AND length(w) >= 4 THEN left(w, -1) ELSE w END"
_REPLIES = f"WITH {SQL_CUR}, r AS (SELECT a.id, coalesce(a.content, '') AS statement, coalesce(b.content, '') AS source FROM cur a JOIN cur b ON b.id = a.reply_to_id WHERE a.deleted_at IS NULL)"


def _replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = current(spark, sf_dir, "content", "reply_to_id", "deleted_at")
    b = c.select(F.col("id").alias("b_id"), F.coalesce("content", F.lit("")).alias("source"))
    return c.where("deleted_at IS NULL").select("id", "reply_to_id", F.coalesce("content", F.lit("")).alias("statement")).join(b, F.col("reply_to_id") == F.col("b_id")).select("id", "statement", "source")


@CORE.query(
    "claim_overlap",
    _REPLIES
    + f""", m AS (SELECT id, unnest(list_filter(regexp_extract_all(lower(statement), '[a-z][a-z0-9]{{2,}}'), lambda t: t NOT IN ({_STOP}))) AS w FROM r),
s AS (SELECT DISTINCT id, {_STEM} AS st FROM (SELECT id, unnest(regexp_extract_all(lower(source), '[a-z][a-z0-9]{{2,}}')) AS w FROM r)),
g AS (SELECT m.id, sum(CASE WHEN w IN ('linker', 'kernel') THEN 2.0 ELSE 1.0 END) AS total, sum(CASE WHEN s.id IS NOT NULL THEN CASE WHEN w IN ('linker', 'kernel') THEN 2.0 ELSE 1.0 END ELSE 0 END) AS got FROM (SELECT id, w, {_STEM} AS st FROM m) m LEFT JOIN s ON s.id = m.id AND s.st = m.st GROUP BY m.id)
SELECT r.id, round(coalesce(got / total, 1), 9)::DOUBLE AS overlap FROM r LEFT JOIN g USING (id)""",
)
def claim_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _replies(spark, sf_dir).select("id", F.round(K.overlap(F.col("statement"), F.col("source"), ("linker", "kernel")), 9).alias("overlap"))


#: Stand-in for a list of machine names: a word and three digits.
MODELS = r"\b[a-z]{4,} [0-9]{3}\b"
_PLAIN = """translate(lower({}), '“”’', '""''')"""


def _sql_map(table: dict) -> str:
    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in table.items()) + "}"


def _sql_in(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _sql_tokens(col: str) -> str:
    """The tokens of a text in SQL, numbers in one form."""
    token = FA.TOKEN.replace("\\x27", "''")
    raw = f"regexp_extract_all({_PLAIN.format(col)}, '(?:{MODELS})|{token}')"
    return f"""list_transform({raw}, lambda t, i: CASE WHEN regexp_full_match(t, '[0-9]{{1,3}}(,[0-9]{{3}})+') THEN replace(t, ',', '')
  WHEN t IN ({_sql_in(FA.NUMBERS)}) AND coalesce({raw}[i + 1] NOT IN ({_sql_in(FA.VAGUE)}), true) THEN {_sql_map(FA.NUMBERS)}[t] WHEN t = 'one' AND {raw}[i + 1] IN ({_sql_in(FA.UNITS)}) THEN '1'
  WHEN regexp_full_match(t, '[0-9]{{1,15}}k') THEN (CAST(left(t, -1) AS BIGINT) * 1000)::VARCHAR WHEN regexp_full_match(t, 'r[0-9]{{1,2}}k') THEN 'r' || (CAST(substring(t, 2, length(t) - 2) AS BIGINT) * 1000)
  WHEN regexp_full_match(t, 'o[0-9]{{3,4}}') THEN 'origin ' || substring(t, 2) ELSE t END)"""


def _sql_amount(x: str) -> str:
    """A decimal without zeros that say nothing."""
    return rf"(CASE WHEN contains({x}, '.') THEN regexp_replace(regexp_replace({x}, '^0+([0-9])', '\1'), '\.?0+$', '') ELSE regexp_replace({x}, '^0+([0-9])', '\1') END)"


def _sql_facts(col: str) -> str:
    """The facts of a list of tokens in SQL."""
    unit, joined = _sql_map(FA.UNITS), r"regexp_extract(t, '^[0-9]+(?:\.[0-9]+)?([a-z]+)$', 1)"
    fact = lambda kind, value: f"{{'kind': '{kind}', 'value': {value}}}"
    return rf"""list_distinct(list_filter(list_transform({col}, lambda t, i: CASE
  WHEN t LIKE '`_%' THEN {fact('file', 'substring(t, 2, length(t) - 2)')} WHEN t LIKE '"_%' THEN {fact('quote', 'substring(t, 2, length(t) - 2)')}
  WHEN regexp_full_match(t, '[0-9]{{3}}-[0-9]{{4}}-[0-9]{{3}}') THEN {fact('part', 't')}
  WHEN regexp_full_match(t, '{MODELS}') OR regexp_full_match(t, 'origin [0-9]{{3,4}}') THEN {fact('model', "regexp_replace(t, '[ ]+', ' ', 'g')")}
  WHEN regexp_full_match(t, '[0-9]+(\.[0-9]+)?') AND {unit}[{col}[i + 1]] IS NOT NULL THEN {fact('quantity', _sql_amount('t') + f" || ' ' || {unit}[{col}[i + 1]]")}
  WHEN {unit}[{joined}] IS NOT NULL THEN {fact('quantity', _sql_amount("regexp_extract(t, '^[0-9.]+')") + f" || ' ' || {unit}[{joined}]")}
  WHEN regexp_full_match(t, '[0-9]+(\.[0-9]+)+[mf]?') THEN {fact('version', "regexp_replace(t, '[mf]$', '')")}
  WHEN regexp_full_match(t, 'r[0-9]{{3,5}}') THEN {fact('cpu', 't')} WHEN regexp_full_match(t, '19[6-9][0-9]|20[0-2][0-9]') THEN {fact('year', 't')}
  WHEN regexp_full_match(t, '[0-9]+') THEN {fact('number', 't')} END), lambda x: x IS NOT NULL))"""


@CORE.query(
    "fact_checks",
    _REPLIES
    + f""", tok AS (SELECT id, statement, source, {_sql_tokens('statement')} AS a, {_sql_tokens('source')} AS b FROM r),
fac AS (SELECT id, statement, {_PLAIN.format('source')} AS src, {_sql_facts('a')} AS mine, {_sql_facts('b')} AS known, flatten(list_transform(b, lambda t: regexp_extract_all(t, '[0-9]+'))) AS digits FROM tok),
lost AS (SELECT id, len(mine) AS n_facts, len(list_filter(mine, lambda f: NOT CASE WHEN f.kind IN ('file', 'quote') THEN contains(src, f.value) WHEN f.kind = 'number' THEN list_contains(digits, f.value)
  ELSE len(list_filter(known, lambda k: k.kind = f.kind AND (k.value = f.value OR f.kind = 'version' AND starts_with(k.value, f.value || '.') OR f.kind = 'model' AND (starts_with(k.value, f.value) OR starts_with(f.value, k.value))))) > 0 END)) AS n_missing FROM fac),
m AS (SELECT id, unnest(list_filter(regexp_extract_all(lower(statement), '[a-z][a-z0-9]{{2,}}'), lambda t: t NOT IN ({_STOP}))) AS w FROM r),
s AS (SELECT DISTINCT id, {_STEM} AS st FROM (SELECT id, unnest(regexp_extract_all(lower(source), '[a-z][a-z0-9]{{2,}}')) AS w FROM r)),
g AS (SELECT m.id, count(*) AS total, count(s.id) AS got FROM (SELECT id, w, {_STEM} AS st FROM m) m LEFT JOIN s ON s.id = m.id AND s.st = m.st GROUP BY m.id)
SELECT lost.id, CASE WHEN n_missing > 0 THEN 'unsupported_fact' WHEN coalesce(got / total, 1) < 0.25 THEN 'low_overlap' WHEN n_facts > 0 THEN 'supported' ELSE 'uncheckable' END AS verdict, n_facts, n_missing, round(coalesce(got / total, 1), 9)::DOUBLE AS overlap FROM lost LEFT JOIN g USING (id)""",
)
def fact_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.check_facts(_replies(spark, sf_dir), models=MODELS).withColumn("overlap", F.round("overlap", 9))


@CORE.query(
    "run_comparison",
    f"WITH {SQL_EM}, t AS (SELECT xid, position, id, {SQL_CLAIM.replace('@c', 'content')} AS w FROM em), a AS (SELECT * FROM t WHERE position % 2 = 0 AND len(w) > 0), b AS (SELECT * FROM t WHERE position % 2 = 1 AND len(w) > 0),"
    " j AS (SELECT a.id, max(len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)))) AS best FROM a LEFT JOIN b USING (xid) GROUP BY a.id) SELECT id, round(coalesce(best, 0), 9) AS best, coalesce(best, 0) >= 0.5 AS reproduced FROM j",
)
def run_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best similarity of one run's claims to the other run's within an exchange, by shared words.

    Only claims that share a word are joined; others have similarity 0.
    """
    t = settle(exchange_messages(spark, sf_dir).select("xid", "position", "id", T.claim_tokens(F.col("content")).alias("w")).where(F.size("w") > 0), "claims")
    a = t.where("position % 2 = 0").select("xid", F.col("id").alias("a"), F.size("w").alias("na"), F.explode("w").alias("x"))
    b = t.where("position % 2 = 1").select("xid", F.col("id").alias("b"), F.size("w").alias("nb"), F.explode("w").alias("x"))
    j = a.join(b, ["xid", "x"]).groupBy("a", "b", "na", "nb").agg(F.count("*").alias("s"))
    best = j.groupBy("a").agg(F.max(F.col("s") / (F.col("na") + F.col("nb") - F.col("s"))).alias("best"))
    out = t.where("position % 2 = 0").select("id").join(best, F.col("id") == F.col("a"), "left").select("id", F.coalesce("best", F.lit(0.0)).alias("best"))
    return out.select("id", F.round("best", 9).alias("best"), (F.col("best") >= 0.5).alias("reproduced"))


@CORE.query(
    "version_diff",
    f"WITH {SQL_CUR}, s AS (SELECT id, max(content) AS content FROM source_messages WHERE NOT is_system GROUP BY id) SELECT CASE WHEN c.id IS NULL THEN 'added' WHEN s.id IS NULL THEN 'dropped' WHEN s.content IS NOT DISTINCT FROM c.content THEN 'exact' ELSE 'changed' END AS state, count(*) AS n FROM s FULL JOIN cur c ON c.id = s.id GROUP BY 1",
)
def version_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "source_messages").where("NOT is_system").groupBy("id").agg(F.max("content").alias("new")).withColumn("s", F.lit(True))
    c = current(spark, sf_dir, "content").select("id", F.col("content").alias("old"), F.lit(True).alias("c"))
    j = s.join(c, "id", "full")
    state = F.when(F.col("c").isNull(), "added").when(F.col("s").isNull(), "dropped").when(F.col("new").eqNullSafe(F.col("old")), "exact").otherwise("changed")
    return j.groupBy(state.alias("state")).agg(F.count("*").alias("n"))


_SHINGLES = """list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)"""


@CORE.query(
    "near_duplicates",
    f"""WITH RECURSIVE d AS (SELECT doc_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}_]+') AS w FROM documents), s AS (SELECT id, {_SHINGLES} AS items FROM d),
k AS (SELECT id, items, len(items) AS n, array_to_string(list_sort(items), '|') AS key FROM s), e AS (SELECT id, n, key, unnest(items) AS item FROM k),
p AS (SELECT a.id AS a, b.id AS b, count(*) AS sh, any_value(a.n) AS na, any_value(b.n) AS nb, any_value(a.key) AS ka, any_value(b.key) AS kb FROM e a JOIN e b ON a.item = b.item AND a.id <> b.id GROUP BY ALL),
l AS (SELECT a, b, ka <> kb AS other FROM p WHERE sh >= 0.8 * (na + nb - sh) - 1e-9),
c AS (SELECT id, id AS label FROM k UNION SELECT l.b, c.label FROM c JOIN l ON l.a = c.id)
SELECT k.id, min(c.label) AS class_id, coalesce((SELECT count(*) FROM l WHERE l.a = k.id AND other), 0) AS n_links, CASE WHEN k.n = 0 THEN 1 ELSE 1 + coalesce((SELECT count(*) FROM l WHERE l.a = k.id AND NOT other), 0) END AS n_copies FROM k JOIN c USING (id) GROUP BY k.id, k.n""",
)
def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = T.all_matches(F.lower(F.coalesce("text", F.lit(""))), r"[\p{L}\p{N}_]+")
    d = spread(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), "id").select("id", w.alias("w"))
    return similar.near_duplicates(d.select("id", similar.shingles(F.col("w"), 5).alias("items")), 0.8)


@CORE.query(
    "claim_groups",
    f"""WITH RECURSIVE {SQL_EM}, c AS (SELECT CAST(channel_id AS VARCHAR) AS topic, id AS claim, {SQL_CLAIM.replace('@c', 'content')} AS w, row_number() OVER (PARTITION BY channel_id ORDER BY id) AS no FROM em),
walk AS (
  SELECT topic, no, claim, claim AS lead, [{{'id': claim, 'w': w}}] AS leads FROM c WHERE no = 1
  UNION ALL SELECT topic, no, claim, coalesce(hit, claim), CASE WHEN hit IS NULL THEN list_append(leads, {{'id': claim, 'w': w}}) ELSE leads END
  FROM (SELECT c.topic, c.no, c.claim, c.w, walk.leads, list_filter(walk.leads, lambda l: len(c.w) > 0 AND len(l.w) > 0 AND len(list_intersect(l.w, c.w)) / (len(l.w) + len(c.w) - len(list_intersect(l.w, c.w))) >= 0.5)[1].id AS hit
    FROM walk JOIN c ON c.topic = walk.topic AND c.no = walk.no + 1))
SELECT topic, claim, lead FROM walk""",
)
def claim_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = exchange_messages(spark, sf_dir).select(F.col("channel_id").cast("string").alias("topic"), F.col("id").alias("claim"), T.claim_tokens(F.col("content")).alias("words"))
    return K.group_claims(m, 0.5)


# ---- topics

#: Stand-in topics: name, aliases as a pattern.
TOPICS = [("build tools", r"\b(?:compiler|linker|makefile)\b"), ("network gear", r"\b(?:router|gateway|firewall)\b"), ("boards", r"\b(?:mainboard|capacitor|chassis)\b"), ("system", r"\b(?:kernel|driver|file system)\b"), ("rail", r"\b(?:tunnel|viaduct|signal box)\b")]
_TOPICS = "topics AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{p}')" for n, p in TOPICS) + ") t(topic, pattern)), ct AS (SELECT em.id AS claim, topic FROM em JOIN topics ON regexp_matches(lower(content), pattern))"


def _claim_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = F.lower("content")
    hit = F.array_compact(F.array(*(F.when(low.rlike(p), F.lit(n)) for n, p in TOPICS)))
    return exchange_messages(spark, sf_dir).select(F.col("id").alias("claim"), F.explode(hit).alias("topic"))


@CORE.query("topic_assign", f"WITH {SQL_EM}, {_TOPICS} SELECT claim, topic FROM ct")
def topic_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _claim_topics(spark, sf_dir)


@CORE.query(
    "co_topic_sections",
    f"WITH {SQL_EM}, {_TOPICS}, p AS (SELECT a.claim, a.topic, b.topic AS other FROM ct a JOIN ct b ON a.claim = b.claim AND a.topic <> b.topic), st AS (SELECT topic, other, count(*) AS s FROM p GROUP BY ALL), best AS (SELECT claim, p.topic, arg_min(p.other, (-s, p.other)) AS section FROM p JOIN st ON st.topic = p.topic AND st.other = p.other GROUP BY ALL),"
    " sz AS (SELECT topic, section, count(*) AS n FROM best GROUP BY ALL) SELECT ct.claim, ct.topic, coalesce(CASE WHEN n >= 3 THEN best.section END, 'General') AS section FROM ct LEFT JOIN best USING (claim, topic) LEFT JOIN sz ON sz.topic = best.topic AND sz.section = best.section",
)
def co_topic_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.sections(settle(_claim_topics(spark, sf_dir), "topics"), 3)


@CORE.query(
    "topic_stats",
    f"WITH {SQL_EM}, {_TOPICS}, n AS (SELECT topic, count(*) AS n, count(DISTINCT author_id) AS speakers FROM ct JOIN em ON em.id = ct.claim GROUP BY topic) SELECT topic, n, speakers, n >= 20 AS has_page FROM n",
)
def topic_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _claim_topics(spark, sf_dir)
    a = current(spark, sf_dir, "author_id").select("id", "author_id")
    return c.join(a, F.col("claim") == F.col("id")).groupBy("topic").agg(F.count("*").alias("n"), F.count_distinct("author_id").alias("speakers")).withColumn("has_page", F.col("n") >= 20)


@CORE.query(
    "display_names",
    "WITH f AS (SELECT lower(trim(term)) AS key, term AS spelling, count(*) AS c FROM mined_terms WHERE trim(term) <> '' GROUP BY ALL) SELECT key, arg_min(spelling, (-c, spelling)) AS name, CAST(sum(c) AS BIGINT) AS n FROM f GROUP BY key",
)
def display_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "mined_terms").where("trim(term) <> ''").select(F.lower(F.trim("term")).alias("key"), "term")
    return K.display_names(t, "key", "term")


def _sql_key(c: str) -> str:
    """A tag's key in SQL; points between digits are kept by way of a sign that no tag holds."""
    low = rf"""ltrim(trim(lower(regexp_replace({c}, '[®™©*"''`‘’“”]|\(\)', '', 'g'))), '$')"""
    own = rf"regexp_replace({low}, '^(?:{'|'.join(K.VENDORS)})\s+(\S)', '\1')"
    packed = rf"regexp_replace({own}, '[\s_/–—-]+', '', 'g')"
    kept = rf"regexp_replace(regexp_replace({packed}, '([0-9])\.([0-9])', '\1§\2', 'g'), '([0-9])\.([0-9])', '\1§\2', 'g')"
    return f"replace(replace({kept}, '.', ''), '§', '.')"


_PLURAL = "length(s) >= 3 AND regexp_matches(s, '[^ s]s$')"


@CORE.query(
    "tag_merges",
    rf"""WITH RECURSIVE f AS (SELECT trim(term) AS tag, {_sql_key('trim(term)')} AS key, count(*) AS n FROM mined_terms WHERE trim(term) <> '' GROUP BY 1, 2),
k AS (SELECT key, CAST(sum(n) AS BIGINT) AS n, arg_min(tag, (-n, tag)) AS s FROM f WHERE key <> '' GROUP BY key),
v AS (SELECT key, n, 0 AS place, regexp_replace(key, '[^\x00-\x7f]', '', 'g') AS w FROM k
  UNION ALL SELECT key, n, 1, regexp_extract(s, '(?i)^(?:the\s+)?(.+?)\s+(?:{'|'.join(K.GENERIC)})s?$', 1) FROM k
  UNION ALL SELECT key, n, 2, regexp_extract(s, '(?i)^the\s+(.+)$', 1) FROM k
  UNION ALL SELECT key, n, 3, left(s, -1) FROM k WHERE {_PLURAL}
  UNION ALL SELECT key, n, 4, CASE WHEN suffix(s, 'ies') THEN left(s, -3) || 'y' WHEN suffix(s, 'es') THEN left(s, -2) END FROM k WHERE {_PLURAL}),
c AS (SELECT key, n, place, {_sql_key('w')} AS target FROM v WHERE w <> ''),
step AS (SELECT c.key, arg_min(c.target, place) AS target FROM c JOIN k t ON t.key = c.target WHERE c.target <> c.key AND t.n >= 0.25 * c.n GROUP BY c.key),
chain AS (SELECT key, target, 1 AS d FROM step UNION ALL SELECT chain.key, step.target, d + 1 FROM chain JOIN step ON step.key = chain.target)
SELECT key, arg_max(target, d) AS target FROM chain GROUP BY key""",
)
def tag_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.merge_map(table(spark, sf_dir, "mined_terms").where("trim(term) <> ''").select(F.trim("term").alias("term")), "term")


_WORDS3 = "SELECT lower(trim(term)) AS term FROM mined_terms WHERE trim(term) <> ''"
_NAMES = f"""ts AS ({_WORDS3}), ws AS (SELECT unnest(list_distinct([split_part(term, ' ', 1), term, split_part(term, ' ', 1)])) AS name FROM ts), nm AS (SELECT name, count(*) AS size FROM ws GROUP BY name),
cd AS (SELECT name, size, 0 AS place, regexp_replace(name, '\\.[0-9]+[a-z]*$', '') AS form FROM nm
  UNION ALL SELECT name, size, k, array_to_string(string_split(name, ' ')[1:len(string_split(name, ' ')) - k], ' ') FROM (SELECT name, size, unnest(range(1, len(string_split(name, ' ')))) AS k FROM nm)
  UNION ALL SELECT name, size, 1000000, regexp_extract(name, '^([A-Za-z]+)[0-9]', 1) FROM nm),
pa AS (SELECT cd.name, arg_min(p.name, (place, -p.size, p.name)) AS parent FROM cd JOIN nm p ON lower(p.name) = lower(form) AND p.size > cd.size WHERE form <> '' AND form <> cd.name GROUP BY cd.name)"""


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms and their first words, with how many rows hold them."""
    t = table(spark, sf_dir, "mined_terms").where("trim(term) <> ''").select(F.lower(F.trim("term")).alias("term"))
    w = t.select(F.explode(F.array_distinct(F.array("term", F.split_part("term", F.lit(" "), F.lit(1))))).alias("name"))
    return settle(w.groupBy("name").agg(F.count("*").alias("size")), "names")


@CORE.query("name_parents", f"WITH {_NAMES} SELECT name, parent FROM pa")
def name_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.parents(_names(spark, sf_dir), "name", "size")


#: Stand-in rules: the second word describes, the first names.
_BY_TEXT, _BY_NAME = [("software", "script|code|log"), ("part", "drive|board|card|lens")], [("machine", "^(server|camera|train|guitar)"), ("part", "cable|disk|film")]
_BY_HAND = [("router", "machine"), ("compiler", "software"), ("court", "place")]


_KINDS = f"""WITH RECURSIVE {_NAMES}, ow AS (SELECT nm.name, coalesce(h.kind, {", ".join(f"CASE WHEN regexp_matches(split_part(nm.name, ' ', 2), '(?i){p}') THEN '{k}' END" for k, p in _BY_TEXT)}, {", ".join(f"CASE WHEN regexp_matches(nm.name, '(?i){p}') THEN '{k}' END" for k, p in _BY_NAME)}) AS kind
  FROM nm LEFT JOIN (VALUES {", ".join(str(x) for x in _BY_HAND)}) h(name, kind) USING (name)),
up AS (SELECT name, name AS at, 0 AS d FROM nm UNION ALL SELECT up.name, pa.parent, d + 1 FROM up JOIN pa ON pa.name = up.at),
fd AS (SELECT up.name, arg_min(kind, d) AS kind FROM up JOIN ow ON ow.name = up.at WHERE kind IS NOT NULL GROUP BY up.name)"""


@CORE.query("kinds", _KINDS + " SELECT nm.name, coalesce(kind, 'other') AS kind FROM nm LEFT JOIN fd USING (name)")
def kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _names(spark, sf_dir)
    d = n.select("name", F.split_part("name", F.lit(" "), F.lit(2)).alias("description"))
    return K.assign_kinds(d, K.parents(n, "name", "size"), spark.createDataFrame(_BY_HAND, "name string, kind string"), _BY_TEXT, _BY_NAME)


@CORE.query("kind_totals", _KINDS + " SELECT coalesce(kind, 'other') AS kind, count(*) AS names, CAST(sum(size) AS BIGINT) AS rows FROM nm LEFT JOIN fd USING (name) GROUP BY 1")
def kind_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = kinds(spark, sf_dir).join(_names(spark, sf_dir), "name")
    return k.groupBy("kind").agg(F.count("*").alias("names"), F.sum("size").alias("rows"))


@CORE.query(
    "sentence_counts",
    r"SELECT doc_id, len(list_filter(string_split_regex(regexp_replace(text, '(?m)^#+ .*$', '', 'g'), '[.!?]\s+|\n+'), lambda s: length(trim(s, E' \t\n\r')) >= 30)) AS n FROM documents WHERE text IS NOT NULL",
)
def sentence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of 30 or more characters; headings don't count."""
    s = F.split(F.regexp_replace("text", r"(?m)^#+ .*$", ""), r"[.!?]\s+|\n+", -1)
    long = F.filter(s, lambda x: F.length(F.regexp_replace(x, "^[ \\t\\n\\r]+|[ \\t\\n\\r]+$", "")) >= 30)
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.size(long).cast("long").alias("n"))


@CORE.query(
    "reference_fit",
    f"WITH s AS (SELECT subject, {SQL_CLAIM.replace('@c', 'about')} AS t FROM subjects), d AS (SELECT doc_id, {SQL_CLAIM.replace('@c', 'text')} AS w FROM documents WHERE text IS NOT NULL) SELECT doc_id, subject, round(len(list_intersect(w, t)) / sqrt(len(w) * len(t)), 9) AS fit FROM d, s WHERE len(list_intersect(w, t)) > 0",
)
def reference_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well reference texts (a small table of fixed size) fit documents, by shared words."""
    s = table(spark, sf_dir, "subjects").select("subject", T.claim_tokens(F.col("about")).alias("t"))
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", T.claim_tokens(F.col("text")).alias("w")).withColumn("nw", F.size("w"))
    j = d.select("doc_id", "nw", F.explode("w").alias("x")).join(s.select("subject", F.size("t").alias("nt"), F.explode("t").alias("x")), "x")
    g = j.groupBy("doc_id", "subject", "nw", "nt").agg(F.count("*").alias("n"))
    return g.select("doc_id", "subject", F.round(F.col("n") / F.sqrt(F.col("nw") * F.col("nt")), 9).alias("fit"))


# ---- vectors


@CORE.query(
    "pooled_vectors",
    "WITH u AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) SELECT label, i AS dim, round(avg(x), 5) AS mean, round(max(x), 5) AS top FROM u GROUP BY label, i",
)
def pooled_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    return u.groupBy("label", (F.col("i") + 1).cast("long").alias("dim")).agg(F.round(F.avg(F.col("x").cast("double")), 5).alias("mean"), F.round(F.max("x").cast("double"), 5).alias("top"))


# ---- privacy


@CORE.query(
    "redacted_messages",
    f"WITH {SQL_CUR}, o AS (SELECT DISTINCT author_id FROM cur WHERE author_id % 7 = 0) SELECT id, CASE WHEN author_id IN (SELECT author_id FROM o) THEN '[redacted]' ELSE coalesce(content, '') END AS content, CASE WHEN author_id IN (SELECT author_id FROM o) THEN '[redacted]' ELSE author_name_at_time END AS name FROM cur",
)
def redacted_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = current(spark, sf_dir, "author_id", "author_name_at_time", "content")
    out = redacted(c, c.where("author_id % 7 = 0").select("author_id").distinct(), ["content", "author_name_at_time"])
    return out.select("id", F.coalesce("content", F.lit("")).alias("content"), F.col("author_name_at_time").alias("name"))


@CORE.query(
    "opt_out_changes",
    f"WITH {SQL_CUR}, a AS (SELECT DISTINCT author_id FROM cur WHERE author_id % 7 = 0), b AS (SELECT DISTINCT author_id FROM cur WHERE author_id % 5 = 0) SELECT author_id, 'added' AS change FROM b WHERE author_id NOT IN (SELECT author_id FROM a) UNION ALL SELECT author_id, 'removed' FROM a WHERE author_id NOT IN (SELECT author_id FROM b)",
)
def opt_out_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = current(spark, sf_dir, "author_id").select("author_id").distinct()
    a, b = ids.where("author_id % 7 = 0"), ids.where("author_id % 5 = 0")
    return b.join(a, "author_id", "left_anti").withColumn("change", F.lit("added")).unionByName(a.join(b, "author_id", "left_anti").withColumn("change", F.lit("removed")))


@CORE.query(
    "stale_exchanges",
    f"WITH {SQL_EM}, ed AS (SELECT id, epoch_us(max(edited_at)) AS us FROM source_messages WHERE edited_at IS NOT NULL GROUP BY id), x AS (SELECT xid, max(us) AS done_us FROM em GROUP BY xid) SELECT em.xid, count(*) AS n_edits FROM em JOIN ed USING (id) JOIN x ON x.xid = em.xid WHERE ed.us > done_us GROUP BY em.xid",
)
def stale_exchanges(spark: SparkSession, sf_dir: str) -> DataFrame:
    em = exchange_messages(spark, sf_dir).select("xid", "id", "us")
    s = latest_by(table(spark, sf_dir, "source_messages").where("edited_at IS NOT NULL"), ["id"], ["edited_at"], ["edited_at"])
    return stale_groups(em, s)
