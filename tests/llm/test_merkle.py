import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from doclake.llm import merkle as M
from doclake.llm.queries import QUERIES

from conftest import SMALL

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def tree(nodes, width):
    """The root, and per node the runs above it as (slot, run)."""
    paths, level, at = [[] for _ in nodes], list(nodes), list(range(len(nodes)))
    while len(level) > 1:
        runs = [level[i:i + width] for i in range(0, len(level), width)]
        for n, path in enumerate(paths):
            path.append((at[n] % width, runs[at[n] // width]))
            at[n] //= width
        level = [sha(*run) for run in runs]
    return level[0], paths


def expected(rows, width=16):
    groups = {}
    for r in rows:
        groups.setdefault(r["source"], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    built = []
    for s in names:
        members = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r["doc_id"], s, r["lang"], r["n_chars"], r["text"])), i)
                         for i, r in enumerate(groups[s]))
        built.append((s, members, *tree([m[0][2] for m in members], width)))
    root, above = tree([b[2] for b in built], width) if built else (None, [])
    out = []
    for (s, members, subroot, paths), upper in zip(built, above):
        for ((_, _, own), i), path in zip(members, paths):
            r, text = groups[s][i], groups[s][i]["text"]
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and text is not None:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            acc, siblings = leaf(r["doc_id"], s, r["lang"], r["n_chars"], text), []
            for slot, run in path + upper:
                siblings += run[:slot] + run[slot + 1:]
                acc = sha(*run[:slot], acc, *run[slot + 1:])
            out.append((r["doc_id"], own, subroot, root, sha(*siblings), acc, acc == root))
    return sorted(out, key=str)


def result(docs, width=16):
    return sorted((tuple(r) for r in M.checked(M.documents_manifest(docs, width)).collect()), key=str)


@pytest.mark.parametrize("width", [2, 16])
def test_runs_proofs_and_tampering(spark, width):
    rng = random.Random(width)
    sizes = {None: 1, "hot": 40, "src17": 17, "src16": 16, "a": 2, "": 1, "é": 33, "z\U0001f600": 4, "Z": 3}
    rows = [dict(doc_id=0, text=rng.choice(["Some Text", "lower", "", None, "ÉA\nB"]), lang=rng.choice(["en", None]), source=s,
                 n_chars=rng.choice([None, 3])) for s, n in sizes.items() for _ in range(n)]
    for i, r in enumerate(rows):
        r["doc_id"] = i
    rng.shuffle(rows)
    assert result(spark.createDataFrame(rows, SCHEMA), width) == expected(rows, width)


def test_null_and_repeated_rows_long_texts_and_clashing_names(spark):
    rows = [dict(doc_id=d, text=t, lang="en", source=s, n_chars=1) for s in (None, "x", "-") for d in (None, 3, 3, 10)
            for t in ("Copy", "Copy", "L" + "ong " * 200_000)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("no") for c in ("tree", "idx", "digest", "path", "_key", "left")})
    assert result(docs) == expected(rows)


def test_one_row_and_empty(spark):
    one = [dict(doc_id=7, text="A", lang=None, source=None, n_chars=None)]
    assert result(spark.createDataFrame(one, SCHEMA)) == expected(one)
    tree = M.documents_manifest(spark.createDataFrame([], SCHEMA))
    assert M.checked(tree).collect() == [] and tree.root().collect() == []


def test_query_against_plain_trees(spark):
    rows = [r.asDict() for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in QUERIES["op12_merkle_manifest"](spark, SMALL).collect()), key=str) == expected(rows)
