import re

from pyspark.sql import functions as F

from conftest import SMALL
from doclake.llm import licenses as L
from doclake.llm.queries import QUERIES
from llm.brute import alnum_words


def brute(text):
    w = alnum_words(text)
    places, base = [], set()
    for phrase, label in L.PHRASES.items():
        p = phrase.split()
        at = [i for i in range(len(w) - len(p) + 1) if w[i:i + len(p)] == p]
        places += at
        base |= {label} if at else set()
    labels, score = set(base), 1.0 if places else 0.0
    for block in re.split(r"(?<=[.!?])\s+|\n\s*\n", text or ""):
        have = set(alnum_words(block))
        for template, label in L.TEMPLATES.items():
            t = set(template.split())
            if 10 * len(t & have) >= L.TENTHS * len(t):
                labels.add(label)
                score = max(score, len(t & have) / len(t))
    return (len(w), len(places), min(places, default=None), max(places, default=None),
            ",".join(sorted(base)), ",".join(sorted(labels)), round(score, 9))


def test_query_matches_brute_force(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = QUERIES["op3_license_scans"](spark, SMALL).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    for r in rows:
        got = (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"], round(r["score"], 9))
        assert got == brute(docs[r["doc_id"]])


CASES = [None, "", " .,!", "cc by cc by cc  by", "CC-BY and cc/by-nc, All Rights Reserved", "general public\nlicense",
         "Licensed under Apache License Version 2.", "licensed under the license. apache version 2 0 license",
         "this work is, under GNU General Public License, version 3; licensed", "kelvin K sign cc by",
         "you may not use this file except in compliance with license", "rights reserved all", "é cc by è",
         "word " * 40_000 + "released under the MIT license " + "tail " * 40_000]


def test_cases_match_brute_force(spark, documents):
    docs = documents(*CASES)
    docs = docs.union(docs.filter("doc_id = 4")).withColumns({"labels": F.lit(1), "_row": F.lit("r"), "n_words": F.lit(0)})
    rows = L.scanned(docs).select("_row.doc_id", "_row.text", F.expr("* EXCEPT (_row)"))
    got = [tuple(r)[2:7] + (r["labels"], round(r["score"], 9)) for r in rows.collect()]
    texts = [r["text"] for r in rows.select("text").collect()]
    assert len(got) == len(CASES) + 1
    assert sorted(map(str, got)) == sorted(str(brute(t)) for t in texts)
    assert L.scanned(docs.limit(0)).count() == 0


def test_a_statement_runs_over_lines_but_not_over_blank_ones(spark, documents):
    docs = documents("Redistribution and use in source and binary forms, with or without\nmodification, are permitted",
                     "Redistribution and use in source and binary forms, with or without\n\nmodification, are permitted")
    rows = {r["doc_id"]: (r["labels"], r["score"]) for r in L.scanned(docs).select("_row.doc_id", "labels", "score").collect()}
    assert rows == {0: ("bsd", 1.0), 1: ("", 0.0)}


def test_no_templates_or_phrases(spark, documents):
    docs = documents("all rights reserved", "released under the MIT license")
    none = L.scanned(docs, templates={}, phrases={}).collect()
    assert all((r["n_base"], r["labels"], r["score"]) == (0, "", 0.0) for r in none)
    own = L.scanned(docs, templates={"released under license": "own", "": "empty"}, phrases={}).orderBy("labels").collect()
    assert [r["labels"] for r in own] == ["", "own"]


def test_main_path_is_native(spark):
    plan = QUERIES["op3_license_scans"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
