import random

from pyspark.sql import functions as F

from conftest import SMALL
from doclake.llm import jaccard_join as J
from doclake.llm.components import components, with_links
from doclake.llm.queries import QUERIES
from llm.brute import similarity_classes


def _classes(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.similarity_classes(df).collect()}


def test_query_matches_all_pairs(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in QUERIES["op9_jaccard_join"](spark, SMALL).collect()}
    assert got == similarity_classes(docs)


def test_near_copies_boilerplate_and_chains_match_all_pairs(spark, documents):
    """Copies with a few changed words around the threshold, texts that are mostly one passage, and drifting chains."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [rng.choice(vocabulary) for _ in range(90)]
    passage = [rng.choice(vocabulary) for _ in range(50)]
    texts, chain = [], list(base)
    for k in range(60):
        copy = list(base)
        for _ in range(rng.randint(0, 3)):
            copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
        texts.append(" ".join(copy))
        texts.append(" ".join(passage + [f"own{k}x{i}" for i in range(rng.randint(0, 14))]))
        chain[rng.randrange(len(chain))] = f"new{k}"
        texts.append(" ".join(chain))
        texts.append(" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 60))))
    texts += [texts[0], texts[0].upper(), texts[1] + "  \n", "one two", "ONE two", "one two three four five", None, "", " \t"]
    texts.append(" ".join(f"long{i}" for i in range(60_000)))
    texts.append(texts[-1] + " end")
    assert _classes(documents(*texts)) == similarity_classes(list(enumerate(texts)))


def test_no_words_are_linked_with_nothing(spark, documents):
    assert _classes(documents(None, "", "  ", "\n")) == {i: (0, i) for i in range(4)}
    assert J.similarity_classes(documents().limit(0)).count() == 0


def test_repeated_rows_null_ids_and_clashing_columns(spark, documents):
    docs = documents("a b c d e f g", "A b c d e f g", "x", None)
    docs = docs.union(docs.limit(1)).union(docs.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    docs = docs.withColumns({"sig": F.lit(1), "node": F.lit("n"), "n_shingles": F.lit(0)})
    rows = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in J.similarity_classes(docs).collect()]
    assert sorted(rows, key=str) == sorted([(0, 3, 0), (0, 3, 0), (1, 3, 0), (None, 3, 0), (2, 1, 2), (3, 0, 3)], key=str)
    kept = J.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == [0, 2, 3, None]


def test_components_of_a_long_path_and_a_star(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(500, 500 + i) for i in range(1, 300)], "a long, b long")
    got = {r["node"]: r["comp"] for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(101)}, **{500 + i: 500 for i in range(300)}}
    assert components(links.limit(0)).count() == 0


def test_unrelated_long_texts_are_told_apart_by_their_ranges(spark, documents):
    rng = random.Random(3)
    docs = documents(*(" ".join(str(rng.random()) for _ in range(n)) for n in (6_000, 6_000, 6_600)))
    rows = J.prefixes(docs, J.frequencies(docs), 8)
    shape = J.freeze(rows.withColumn("node", F.col("doc_id")), "shape").select("node", "n", "profile")
    pairs = spark.createDataFrame([(0, 1), (0, 2), (1, 2)], "a long, b long")
    assert J._plausible(pairs, shape, 8).count() == 0
    same = spark.createDataFrame([(0, 0)], "a long, b long")
    assert J._plausible(same, shape, 8).count() == 1


def test_ranges_of_sizes_beside_a_power_of_two_are_compared(spark, documents):
    words = [f"w{i}" for i in range(1_130)]
    texts = [" ".join(words[:n]) for n in (900, 1_020, 1_035, 1_130)]
    got = _classes(documents(*texts))
    assert got == similarity_classes(list(enumerate(texts)))
    assert {c for _, c in got.values()} == {0}


def test_pairs_of_a_group_of_changed_copies_grow_with_its_size(spark, documents, monkeypatch):
    """Copies with a few changes each, of which many are similar to the first text only."""
    rng = random.Random(11)
    base = [f"b{i}" for i in range(150)]
    texts = []
    for k in range(400):
        copy = list(base)
        for _ in range(rng.randint(2, 5)):
            copy[rng.randrange(150)] = f"own{k}x{rng.random()}"
        texts.append(" ".join(copy))
    texts.insert(250, " ".join(base))
    tried, freeze = [], J.freeze

    def counted(df, name):
        out = freeze(df, name)
        if name.endswith("_pairs"):
            tried.append(out.count())
        return out
    monkeypatch.setattr(J, "freeze", counted)
    assert _classes(documents(*texts)) == similarity_classes(list(enumerate(texts)))
    assert sum(tried) <= 2 * len(texts)


def test_only_the_result_stays_stored(spark, documents):
    root = spark.conf.get("spark.checkpoint.dir")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    stored = lambda: {str(x.getPath()) for x in fs.listStatus(path)} if fs.exists(path) else set()
    before = stored()
    rows = J.similarity_classes(documents("a b c d e f g", "A b c d e f g", "x"))
    assert rows.count() == 3
    assert len(stored() - before) == 1


def test_links_between_components_join_them(spark):
    schema = "a long, b long"
    first = [(1, 2), (2, 3), (10, 11), (20, 21), (20, 22)]
    more = [(3, 11), (30, 22), (40, 41), (1, 3)]
    comps = with_links(components(spark.createDataFrame(first, schema)), spark.createDataFrame(more, schema))
    whole = components(spark.createDataFrame(first + more, schema))
    assert sorted(map(tuple, comps.collect())) == sorted(map(tuple, whole.collect()))
