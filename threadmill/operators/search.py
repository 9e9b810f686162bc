"""Full-text search, term statistics and their helpers over message tables.

An inverted index is a table (term, id, tf) that is rebuilt from the readable
messages, so redactions reach it with the next build.  Scores are bm25 with
k1 = 1.2 and b = 0.75.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..storage import settle

TERM = r"[\p{L}\p{N}_./-]*[\p{L}\p{N}]"
K1, B = 1.2, 0.75


def inverted_index(messages: DataFrame, id_col: str = "id", text_col: str = "content", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, kept columns, term, tf.  Null and empty texts have no terms."""
    t = messages.select(F.col(id_col).alias("id"), *keep, F.explode(T.all_matches(F.lower(F.col(text_col)), TERM)).alias("term"))
    return t.groupBy("id", *keep, "term").agg(F.count("*").alias("tf"))


def scores(messages: DataFrame, query: str, keep: tuple[str, ...] = ()) -> tuple[DataFrame, int]:
    """bm25 of all messages that hold a term of the query: id, kept columns, terms, score; and the number of terms."""
    spark = messages.sparkSession
    wanted = spark.range(1).select(T.match_terms(F.lit(query)).alias("t")).first()["t"]
    # Only the query's terms are kept; lengths need a count, not the terms.
    found = T.all_matches(F.lower("content"), TERM)
    d = messages.select("id", *keep, found.alias("t")).withColumn("n", F.size("t")).where("n > 0")
    stats = d.agg(F.count("*").alias("docs"), F.avg("n").alias("mean"))
    hit = d.select("id", *keep, "n", F.explode(F.filter("t", lambda x: x.isin(wanted))).alias("term")).groupBy("id", *keep, "n", "term").agg(F.count("*").alias("tf"))
    df = hit.groupBy("term").agg(F.count("*").alias("df"))
    # One row, and one row per query term.
    j = hit.join(F.broadcast(df), "term").join(F.broadcast(stats), F.lit(True))
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("n") / F.col("mean")))
    return j.groupBy("id", *keep).agg(F.count("*").alias("terms"), F.sum(part).alias("score")), len(wanted)


def search(messages: DataFrame, query: str, limit: int, every: bool = True) -> DataFrame:
    """The best messages that hold all (``every``) or any terms: id, score; ties by id."""
    s, n = scores(messages, query)
    s = s.where(F.col("terms") == n) if every else s
    return s.orderBy(F.desc("score"), "id").limit(limit).select("id", F.round("score", 6).alias("score"))


def search_groups(messages: DataFrame, query: str, limit: int) -> DataFrame:
    """The best exchanges by the sum of their messages' scores: xid, score, n_hits, latest; ties by recency."""
    s, n = scores(messages, query, ("xid",))
    g = s.where(F.col("terms") == n).groupBy("xid").agg(F.sum("score").alias("score"), F.count("*").alias("n_hits"), F.max("id").alias("latest"))
    return g.orderBy(F.desc("score"), F.desc("latest")).limit(limit).withColumn("score", F.round("score", 6))


def group_hits(messages: DataFrame, query: str, limit: int, opted_out: DataFrame) -> DataFrame:
    """``search_groups`` with participants (distinct authors that didn't opt out) and the two best messages' snippets."""
    s, n = scores(messages, query, ("xid",))
    s = settle(s.where(F.col("terms") == n), "hits")
    g = s.groupBy("xid").agg(F.sum("score").alias("score"), F.count("*").alias("n_hits"), F.max("id").alias("latest"))
    top = settle(g.orderBy(F.desc("score"), F.desc("latest")).limit(limit).select("xid", F.round("score", 6).alias("score"), "n_hits"), "top")
    best = s.join(top.select("xid"), "xid", "left_semi").withColumn("rn", F.row_number().over(Window.partitionBy("xid").orderBy(F.desc(F.round("score", 6)), "id"))).where("rn <= 2").select("id", "rn")
    mine = messages.join(top.select("xid"), "xid", "left_semi")
    text = mine.join(best, "id").groupBy("xid").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rn", T.snippet(F.col("content")).alias("t")))), lambda x: x["t"]), " | ").alias("snippets"))
    people = mine.join(opted_out.select("author_id").distinct(), "author_id", "left_anti").groupBy("xid").agg(F.count_distinct("author_id").alias("participants"))
    return top.join(text, "xid").join(people, "xid", "left").select("xid", "score", "n_hits", F.coalesce("participants", F.lit(0)).alias("participants"), "snippets")


#: Messages that a window of ``channel_context`` holds on average if all are of one channel.
CHUNK_ROWS = 50_000


def channel_context(messages: DataFrame, hit: Column, size: int) -> DataFrame:
    """The ``size`` messages before and after each hit in its whole channel, by id: hit_id, id, distance.

    Messages are numbered within a channel's chunks of ids; what lies beyond a
    chunk's border comes from the first and last ``size`` ids of the channel's
    chunks, so no window holds more than a channel's messages of one chunk.
    Chunks make no difference to the result.  Messages without a channel have none.
    """
    m = messages.select("channel_id", "id", F.coalesce(hit, F.lit(False)).alias("hit")).where("channel_id IS NOT NULL AND id IS NOT NULL")
    span = m.agg(F.min("id").alias("lo"), F.greatest(F.lit(1), F.ceil((F.max("id") - F.min("id") + 1) / F.ceil(F.count("*") / CHUNK_ROWS))).cast("long").alias("width"))
    m = m.join(F.broadcast(span), F.lit(True)).withColumn("chunk", F.expr("(id - lo) div width"))  # one row
    w = Window.partitionBy("channel_id", "chunk").orderBy("id")
    up = F.row_number().over(w)
    m = m.withColumn("up", up).withColumn("down", F.count("*").over(Window.partitionBy("channel_id", "chunk")) - F.col("up") + 1)
    sides = [(k, F.lag("id", k).over(w), F.lead("id", k).over(w)) for k in range(1, size + 1)]
    m = m.withColumns({f"b{k}": b for k, b, _ in sides} | {f"a{k}": a for k, _, a in sides})
    x = Window.partitionBy("channel_id").orderBy("id")
    edges = m.where((F.col("up") <= size) | (F.col("down") <= size)).select("channel_id", "chunk", "up", "down", *(f(F.col("id"), k).over(x).alias(f"{c}{k}") for k in range(1, size + 1) for f, c in ((F.lag, "b"), (F.lead, "a"))))
    beyond = edges.groupBy("channel_id", "chunk").agg(
        F.min_by(F.array(*(f"b{k}" for k in range(1, size + 1))), "up").alias("before"), F.min_by(F.array(*(f"a{k}" for k in range(1, size + 1))), "down").alias("after")
    )
    cells = [F.struct(F.col("id"), F.lit(0).cast("long").alias("distance"))]
    for k in range(1, size + 1):
        for c, place, far, sign in (("b", "up", "before", -1), ("a", "down", "after", 1)):
            # The k-th message is the (k - place + 1)-th beyond the border.
            other = F.when(F.col(place) > k, F.col(f"{c}{k}")).otherwise(F.get(far, F.lit(k) - F.col(place)))
            cells.append(F.struct(other.alias("id"), F.lit(sign * k).cast("long").alias("distance")))
    near = m.where("hit").join(beyond, ["channel_id", "chunk"]).select(F.col("id").alias("hit_id"), F.explode(F.array(*cells)).alias("c"))
    return near.select("hit_id", "c.id", "c.distance").where("id IS NOT NULL")


def members(messages: DataFrame, salt: str) -> DataFrame:
    """Authors of each exchange by first appearance: xid, author_id, no, pseudonym, member."""
    f = messages.groupBy("xid", "author_id").agg(F.min("position").alias("first"))
    no = F.row_number().over(Window.partitionBy("xid").orderBy("first")) - 1
    return f.withColumn("no", no).select("xid", "author_id", "no", T.pseudonym(F.col("author_id"), salt).alias("pseudonym"), T.letters(F.col("no")).alias("member"))


def unique_pseudonyms(authors: DataFrame, salt: str) -> DataFrame:
    """A pseudonym per author; all but the smallest id of those that would share one get a wider one."""
    short, wide = T.pseudonym(F.col("author_id"), salt, 4), T.pseudonym(F.col("author_id"), salt, 12)
    rn = F.row_number().over(Window.partitionBy(short).orderBy("author_id"))
    return authors.withColumn("rn", rn).select("author_id", F.when(F.col("rn") == 1, short).otherwise(wide).alias("pseudonym"))


def document_frequency(docs: DataFrame, group: str, text_col: str) -> DataFrame:
    """In how many texts of each group a term occurs: group, term, n_docs."""
    t = docs.select(group, F.explode(T.word_tokens(F.col(text_col))).alias("term"))
    return t.groupBy(group, "term").agg(F.count("*").alias("n_docs"))


def _term_sums(mined: DataFrame) -> DataFrame:
    t = mined.select(F.lower(F.trim("term")).alias("term"), F.coalesce("tech", F.lit(0)).alias("tech"), F.coalesce("off", F.lit(0)).alias("off")).where("term <> ''")
    sums = t.groupBy("term").agg(F.sum("tech").alias("tech"), F.sum("off").alias("off"))
    return sums.join(F.broadcast(sums.agg(F.sum("tech").alias("tech_all"), F.sum("off").alias("off_all"))), F.lit(True))  # one row


def mine_terms(mined: DataFrame, least: int = 30, limit: int = 400) -> DataFrame:
    """Terms that speak for the tech side: smoothed log odds above 0, the best ``limit``."""
    s = _term_sums(mined)
    odds = F.log((F.col("tech") + 0.5) / (F.col("tech_all") + 1)) - F.log((F.col("off") + 0.5) / (F.col("off_all") + 1))
    s = s.withColumn("log_odds", F.round(odds, 6)).where((F.col("tech") >= least) & (odds > 0))
    return s.orderBy(F.desc("log_odds"), "term").limit(limit).select("term", "tech", "off", "log_odds")


def collisions(mined: DataFrame, least_off: int = 10, ratio: float = 10.0) -> DataFrame:
    """Tech terms that also occur off topic: the rate of tech is less than ``ratio`` times the other."""
    s = _term_sums(mined)
    rate = (F.col("tech") / F.col("tech_all")) / (F.col("off") / F.col("off_all"))
    return s.where((F.col("off") >= least_off) & (F.col("tech") > 0) & (rate < ratio)).select("term", "tech", "off")


def token_windows(messages: DataFrame, size: int) -> DataFrame:
    """Messages of an exchange packed into windows of at most ``size`` tokens: xid, window_no, n (pieces), tokens.

    Messages are taken in order; a new window begins where the next one
    doesn't fit, and a message longer than a window is cut into pieces first.
    Exchanges are of bounded size, so one is folded in one row.
    """
    c = F.col("content")
    chars = size * 4
    pieces = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(1), F.ceil(F.length(c) / chars)).cast("int") - 1), lambda i: F.ceil(F.least(F.lit(chars), F.length(c) - i * chars) / 4).cast("long"))
    g = messages.groupBy("xid").agg(F.sort_array(F.collect_list(F.struct("position", pieces.alias("t")))).alias("m"))
    g = g.select("xid", F.flatten(F.transform("m", lambda x: x["t"])).alias("t"))
    start = F.array().cast("array<struct<n:bigint,tokens:bigint>>")

    def add(windows: Column, t: Column) -> Column:
        last = F.element_at(windows, -1)
        fits = (F.size(windows) > 0) & (F.coalesce(last["tokens"], F.lit(0)) + t <= size)
        one = F.array(F.struct(F.lit(1).cast("long").alias("n"), t.alias("tokens")))
        more = F.concat(F.slice(windows, F.lit(1), F.greatest(F.lit(0), F.size(windows) - 1)), F.array(F.struct((last["n"] + 1).alias("n"), (last["tokens"] + t).alias("tokens"))))
        return F.when(fits, more).otherwise(F.concat(windows, one))

    w = g.select("xid", F.posexplode(F.aggregate("t", start, add)).alias("window_no", "w"))
    return w.select("xid", F.col("window_no").cast("long").alias("window_no"), "w.n", "w.tokens")
