"""Event sequences, samples, clusters and distances."""

from __future__ import annotations

from pyspark.sql import functions as F

from logquarry.functions.arrays import posexplode_rows
from logquarry.operators import clustering as cg
from logquarry.operators import sequences as sq
from logquarry.plans import inputs as inp
from logquarry.plans.registry import query, with_

H = 20
TYPES = ["click", "error", "purchase", "signup", "view"]


def events(spark, sf):
    return inp.table(spark, sf, "events").select(
        F.expr(f"event_id div {inp.EVENT_CHUNK}").alias("chunk_id"), "event_id", "event_type"
    )


def windows(spark, sf):
    return sq.event_windows(events(spark, sf), "event_id", "event_type", H)


WINDOWS = (
    f"e AS (SELECT event_id // {inp.EVENT_CHUNK} AS chunk_id, event_id, event_type FROM events)",
    f"s AS (SELECT *, (row_number() OVER (PARTITION BY chunk_id ORDER BY event_id) - 1) // {H} AS seq_no FROM e)",
)


@query(
    "event_windows",
    with_(
        *WINDOWS,
        select=f"""SELECT chunk_id, seq_no, string_agg(event_type, ',' ORDER BY event_id) || repeat(',-1', CAST({H} - count(*) AS BIGINT)) AS events
FROM s GROUP BY chunk_id, seq_no""",
    ),
)
def event_windows(spark, sf):
    return windows(spark, sf).withColumn("events", F.array_join("events", ","))


@query(
    "event_vectors",
    with_(
        *WINDOWS,
        "c AS (SELECT chunk_id, seq_no, event_type, count(*) AS n FROM s GROUP BY ALL)",
        "t AS (SELECT count(*) AS total FROM (SELECT DISTINCT chunk_id, seq_no FROM s))",
        "d AS (SELECT event_type, ln((total + 1) / (count(*) + 1)) AS idf FROM c, t GROUP BY event_type, total)",
        "w AS (SELECT event_type, 1 / (1 + exp(-(idf - (SELECT avg(idf) FROM d)))) AS w FROM d)",
        select="SELECT chunk_id, seq_no, c.event_type AS event, round(n * w, 6) AS weight FROM c JOIN w ON c.event_type = w.event_type",
    ),
)
def event_vectors(spark, sf):
    return sq.event_vectors(windows(spark, sf)).withColumn("weight", F.round("weight", 6))


def drawn(*keys: str) -> str:
    """The number that decides about a key, in SQL."""
    text = " || ':' || ".join(["'1'", *[f"CAST({k} AS VARCHAR)" for k in keys]])
    return f"(('0x' || substr(md5({text}), 1, 8))::BIGINT / 4294967296.0)"


@query("block_sample", with_(inp.EVENT_LINES, select=f"SELECT chunk_id, line_no, line FROM event_lines WHERE {drawn('chunk_id', 'line_no // 20')} < 0.1"))
def block_sample(spark, sf):
    return sq.block_sample(inp.event_lines(spark, sf), 0.1, seed=1)


@query("random_sample", with_(inp.EVENT_LINES, select=f"SELECT chunk_id, line_no, line FROM event_lines WHERE {drawn('chunk_id', 'line_no')} < 0.01"))
def random_sample(spark, sf):
    return sq.random_sample(inp.event_lines(spark, sf), ["chunk_id", "line_no"], 0.01, seed=1)


@query("fixed_sample", with_(inp.DOC_LINES, select=f"SELECT chunk_id, line_no, line FROM doc_lines ORDER BY {drawn('chunk_id', 'line_no')}, chunk_id, line_no LIMIT 64"))
def fixed_sample(spark, sf):
    return sq.fixed_sample(inp.doc_lines(spark, sf), ["chunk_id", "line_no"], 64, seed=1)


@query("balanced_sample")
def balanced_sample(spark, sf):
    return sq.balanced_sample(events(spark, sf), "event_type", ["event_id"], 128, seed=1)


def _vectors(spark, sf):
    return sq.dense_vectors(sq.event_vectors(windows(spark, sf)), TYPES)


@query("iterative_clusters")
def iterative_clusters(spark, sf):
    placed, _ = sq.iterative_clusters(_vectors(spark, sf), ["chunk_id", "seq_no"], sample_size=100, threshold=2.0, seed=1)
    return placed.groupBy("centre").agg(F.count(F.lit(1)).alias("n"))


@query(
    "nearest_centre",
    """WITH v AS (SELECT vec_id, embedding AS v FROM embeddings), c AS (SELECT v, vec_id AS k FROM v WHERE vec_id IN (0, 1, 2)),
d AS (SELECT v.vec_id, c.k, sqrt(list_sum(list_transform(list_zip(v.v, c.v), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE)))) AS d FROM v, c)
SELECT vec_id, CASE WHEN min(d) < 1.3 THEN arg_min(k, d) END::INTEGER AS centre FROM d GROUP BY vec_id""",
)
def nearest_centre(spark, sf):
    e = inp.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    centres = [r["vec"] for r in e.filter(F.col("vec_id").isin(0, 1, 2)).orderBy("vec_id").collect()]
    return sq.assign_nearest(e, centres, 1.3).select("vec_id", "centre")


@query(
    "sequence_patterns",
    with_(
        *WINDOWS,
        "t AS (SELECT chunk_id, seq_no, string_agg(event_type, ';' ORDER BY event_id) || ';' AS x FROM s GROUP BY chunk_id, seq_no)",
        select="""SELECT chunk_id, seq_no, CASE WHEN regexp_matches(x, '^([^;]*;)*?error;error;([^;]*;)*?view;click;') THEN 0
  WHEN regexp_matches(x, '^([^;]*;)*?purchase;([^;]*;)*?signup;signup;') THEN 1 END::INTEGER AS pattern FROM t""",
    ),
)
def sequence_patterns(spark, sf):
    patterns = [[["error", "error"], ["view", "click"]], [["purchase"], ["signup", "signup"]]]
    return sq.match_patterns(windows(spark, sf), patterns).select("chunk_id", "seq_no", "pattern")


@query("mined_patterns")
def mined_patterns(spark, sf):
    """What windows that begin with the same event have in common."""
    w = windows(spark, sf).withColumn("first", F.get("events", F.lit(0)))
    return sq.mined_patterns(w, "first", ["chunk_id", "seq_no"], 4, seed=1)


def _orders(spark, sf):
    return inp.table(spark, sf, "orders").select(
        F.concat("o_orderpriority", F.lit(" "), "o_orderstatus", F.lit(" "), F.date_format("o_orderdate", "yyyy-MM")).alias("x")
    )


_FARTHEST = """r{k} AS (SELECT x, d, least(near, levenshtein(x, (SELECT x FROM p{j})) / greatest(length(x), length((SELECT x FROM p{j})))) AS near FROM r{j}),
p{k} AS (SELECT x FROM r{k} ORDER BY near DESC, d DESC, x DESC LIMIT 1)"""


@query(
    "diverse_texts",
    with_(
        "t AS (SELECT DISTINCT o_orderpriority || ' ' || o_orderstatus || ' ' || strftime(o_orderdate, '%Y-%m') AS x FROM orders)",
        f"r0 AS (SELECT x, {drawn('x')} AS d, 'inf'::DOUBLE AS near FROM t)",
        "p0 AS (SELECT x FROM r0 ORDER BY d DESC, x DESC LIMIT 1)",
        *[_FARTHEST.format(k=k, j=k - 1) for k in range(1, 5)],
        select=" UNION ALL ".join(f"SELECT {k}::INTEGER AS round, x AS text FROM p{k}" for k in range(5)),
    ),
)
def diverse_texts(spark, sf):
    return sq.diverse_sample(_orders(spark, sf), "x", 5, sq.normalized_edit_distance, seed=1)


@query("text_patterns")
def text_patterns(spark, sf):
    return sq.pattern_sample(_orders(spark, sf), "x", sq.normalized_edit_distance, patterns=8, near=0.2, far=0.4, seed=1)


def line_pairs(spark, sf):
    """Each document line with the next one."""
    d = inp.table(spark, sf, "documents").select("doc_id", F.split("text", "\n", -1).alias("l"))
    pairs = F.arrays_zip(
        F.slice("l", F.lit(1), F.size("l") - 1).alias("a"), F.slice("l", F.lit(2), F.size("l") - 1).alias("b")
    )
    return posexplode_rows(d.filter(F.size("l") > 1), ["doc_id"], pairs, "pos", "p").select(
        "doc_id", F.col("pos").cast("bigint").alias("pos"), "p.a", "p.b"
    )


PAIRS = """d AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
x AS (SELECT doc_id, l, unnest(range(1, len(l))) AS i FROM d WHERE len(l) > 1),
p AS (SELECT doc_id, i - 1 AS pos, l[i] AS a, l[i + 1] AS b FROM x)"""


def _sets(n: int) -> str:
    def grams(c: str) -> str:
        words = f"string_split({c}, ' ')"
        return f"list_distinct(list_transform(range(1, greatest(len({words}) - {n} + 2, 1)), lambda k: array_to_string({words}[k:k + {n} - 1], ' ')))"

    return f"g AS (SELECT doc_id, pos, {grams('a')} AS ga, {grams('b')} AS gb FROM p)"


def _register_ngram(n: int) -> None:
    @query(
        f"ngram_distance_{n}",
        with_(
            PAIRS,
            _sets(n),
            select="""SELECT doc_id, pos, round((len(ga) + len(gb) - 2 * len(list_intersect(ga, gb))) / nullif(len(ga) + len(gb), 0), 6) AS distance FROM g""",
        ),
    )
    def ngram(spark, sf):
        p = line_pairs(spark, sf).select("doc_id", "pos", F.split("a", " ", -1).alias("a"), F.split("b", " ", -1).alias("b"))
        return sq.pair_distance(p, "a", "b", f"ngram_{n}").select("doc_id", "pos", F.round("distance", 6).alias("distance"))


for _n in (1, 2, 3):
    _register_ngram(_n)


@query(
    "jaccard_distance",
    with_(
        PAIRS,
        "g AS (SELECT doc_id, pos, list_distinct(string_split(a, ' ')) AS ga, list_distinct(string_split(b, ' ')) AS gb FROM p)",
        select="SELECT doc_id, pos, round(1 - len(list_intersect(ga, gb)) / (len(ga) + len(gb) - len(list_intersect(ga, gb))), 6) AS distance FROM g",
    ),
)
def jaccard_distance(spark, sf):
    p = line_pairs(spark, sf).select("doc_id", "pos", F.split("a", " ", -1).alias("a"), F.split("b", " ", -1).alias("b"))
    return sq.pair_distance(p, "a", "b", "jaccard").select("doc_id", "pos", F.round("distance", 6).alias("distance"))


@query(
    "edit_distance",
    """WITH p AS (SELECT a.o_orderkey, a.o_orderpriority || a.o_orderstatus AS x, b.o_orderpriority || b.o_orderstatus AS y FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 1)
SELECT o_orderkey, levenshtein(x, y) AS distance, round(levenshtein(x, y) / greatest(length(x), length(y)), 6) AS normalized FROM p""",
)
def edit_distance(spark, sf):
    o = inp.table(spark, sf, "orders").select("o_orderkey", F.concat("o_orderpriority", "o_orderstatus").alias("x"))
    p = o.join(o.select((F.col("o_orderkey") - 1).alias("o_orderkey"), F.col("x").alias("y")), "o_orderkey")
    return p.select(
        "o_orderkey",
        sq.edit_distance(F.col("x"), F.col("y")).cast("bigint").alias("distance"),
        F.round(sq.normalized_edit_distance(F.col("x"), F.col("y")), 6).alias("normalized"),
    )


@query(
    "vector_distances",
    """WITH p AS (SELECT a.vec_id, list_transform(a.embedding, lambda z: z::DOUBLE) AS x, list_transform(b.embedding, lambda z: z::DOUBLE) AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, round(sqrt(list_sum(list_transform(list_zip(x, y), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) / len(x), 6) AS euclidean,
  round(1 - list_sum(list_transform(list_zip(x, y), lambda z: z[1] * z[2])) / (sqrt(list_sum(list_transform(x, lambda z: z * z))) * sqrt(list_sum(list_transform(y, lambda z: z * z)))), 6) AS cosine FROM p""",
)
def vector_distances(spark, sf):
    e = inp.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    p = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y")), "vec_id")
    return p.select(
        "vec_id",
        F.round(sq.euclidean_per_length(F.col("x"), F.col("y")), 6).alias("euclidean"),
        F.round(sq.cosine_distance(F.col("x"), F.col("y")), 6).alias("cosine"),
    )


@query("lcs_distance")
def lcs_distance(spark, sf):
    """Between each event window and the next of its chunk."""
    w = windows(spark, sf)
    n = w.select("chunk_id", (F.col("seq_no") - 1).alias("seq_no"), F.col("events").alias("following"))
    p = w.join(n, ["chunk_id", "seq_no"])
    return sq.pair_distance(p, "events", "following", "lcs").select("chunk_id", "seq_no", "distance")


# --- clustering by a chosen distance

MOODS = ["urgent parcel goes out first {} today", "slow boat waits in harbour {} nights", "{} crates stay here until further notice", "nobody signed paper number {} yet"]


def mood_items(spark, sf):
    """Orders as sentences of four far kinds with a number each, their words, and a vector."""
    o = inp.table(spark, sf, "orders")
    kind = (F.col("o_orderkey") % 4).cast("int")
    texts = F.array(*[F.lit(m) for m in MOODS])
    text = F.replace(F.get(texts, kind), F.lit("{}"), (F.col("o_custkey") % 10).cast("string"))
    vec = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.when(i == kind, 4.0).otherwise((F.col("o_custkey") % 5) / 10))
    return o.select("o_orderkey", text.alias("text"), F.split(text, " ").alias("words"), vec.alias("vec"))


def _register_clusters(name: str, threshold: float) -> None:
    @query(
        f"clusters_by_{name}",
        "SELECT o_orderkey, min(o_orderkey) OVER (PARTITION BY o_orderkey % 4) AS first_key FROM orders",
    )
    def clusters(spark, sf):
        """Each cluster named by its least key, so that the answer does not depend on the sample."""
        item = F.struct("text", "words", "vec")
        placed = cg.iterative_clusters(mood_items(spark, sf), ["o_orderkey"], item, name, threshold, sample_size=60)
        least = placed.groupBy("centre").agg(F.min("o_orderkey").alias("first_key"))
        return placed.join(least, placed["centre"].eqNullSafe(least["centre"])).select("o_orderkey", "first_key")


for _name, _threshold in (("edit", 0.3), ("ngram_2", 0.6), ("lcs", 0.5), ("mixed", 0.4)):
    _register_clusters(_name, _threshold)
