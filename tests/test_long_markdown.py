"""Blocks with carried states against the rules on whole texts."""

import random

import pytest
from pyspark.sql import functions as F

from doclake.functions.markdown import clean_markdown
from doclake.operators import long_markdown, scans
from doclake.sources.uploads import to_lines

LINES = ["", "  ", "plain text here", "문장이 이어", "| a | b |", "- 항목 하나", "  - 둘째 항목,", "- 하여 이어진다", "    - deep", "- □ 큰 것", "- ㅇ 중간",
         "- ▪ 작은 것", "- □", "- ㅇ ", "- l", "- l 하나", "ㅇ", "□ ", "- [x] □", "※ 주의", "* note", "** note", "- ※ 주의", "- * x", "## 1. 제목",
         "## 2", "## ■ 장", "## 제목만", "## Ⅱ", "## 가. 작은", "## 1-2. 절", "### other", "- ① 첫째", "→ next", "- ㅇ ㅇ  겹친", "- 및 계속", " glyph",
         "끝나는 ", "글 로 벌  기 술", "a  b   c", "- 등", "- ㅇ 등 여러", "것과", "- 사과 및", "-", "- ", "#", "##", "text,", "¡ x", "- ¡", "  - ▪ ▪  twice"]


def texts(seed, n):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        kinds = rng.sample(LINES, rng.choice([2, 4, 8, len(LINES)]))
        if rng.random() < 0.4:      # one marker throughout, so that levels are recovered
            kinds = [k for k in kinds if not k.startswith("###")] + ["## 제목만", "## 1. 제목"]
        out.append("\n".join(rng.choice(kinds) for _ in range(rng.choice([0, 1, 5, 30, 60]))))
    return out


@pytest.mark.parametrize("per_block, fan", [(1, 2), (3, 4), (7, 512)])
def test_blocks_give_what_whole_texts_give(spark, per_block, fan, monkeypatch):
    monkeypatch.setattr(scans.states_before, "__defaults__", (fan,))
    docs = spark.createDataFrame(list(enumerate(texts(per_block, 250))), "doc_id long, text string").repartition(4)
    want = {r.doc_id: r.text for r in docs.select("doc_id", clean_markdown(F.col("text")).alias("text")).collect()}
    got = {r.doc_id: r.text for r in long_markdown.clean_docs(to_lines(docs), lines_per_block=per_block).collect()}
    wrong = [(d, want[d], got.get(d)) for d in want if got.get(d) != want[d]]
    assert not wrong, wrong[0]


def test_a_long_document_is_spread(spark):
    """Lists that never end, with depths and headings that depend on the first lines."""
    body = ["- ㅇ 목록이 열린다", "      - 아주 깊은 항목"]
    rows = body + ["  - 같은 깊이의 항목" if i % 3 else "    - 더 깊은 항목" for i in range(30_000)] + ["## 1. 장", "## 이름뿐"] * 5_000
    lines = spark.createDataFrame([(7, i, x) for i, x in enumerate(rows)], "doc_id long, n long, x string").repartition(8)
    blocks = long_markdown.clean_blocks(lines, lines_per_block=500).collect()
    assert len(blocks) > 70 and max(len(b.text.split("\n")) for b in blocks) < 1_200
    text = "".join(b.text for b in sorted(blocks, key=lambda b: b.part))
    docs = spark.createDataFrame([(7, "\n".join(rows))], "doc_id long, text string")
    assert text == docs.select(clean_markdown(F.col("text"))).first()[0] + "\n"


def test_no_lines(spark):
    lines = spark.createDataFrame([], "doc_id long, n long, x string")
    assert long_markdown.clean_docs(lines).collect() == []


def test_documents_of_one_part_take_no_scan(spark, monkeypatch):
    stored = {}

    def noted(df, name, freeze=long_markdown.freeze):
        stored[name] = freeze(df, name)
        return stored[name]
    monkeypatch.setattr(long_markdown, "freeze", noted)
    rows = [(i, "\n".join(LINES[i:i + 1 + i % 8])) for i in range(30)] + [(77, "\n".join(LINES)), (78, "\n".join(LINES[:8]))]
    docs = spark.createDataFrame([*rows, (None, "- ㅇ x")], "doc_id long, text string").repartition(3)
    want = {r.doc_id: r.text for r in docs.filter("doc_id IS NOT NULL").select("doc_id", clean_markdown(F.col("text")).alias("text")).collect()}
    assert {r.doc_id: r.text for r in long_markdown.clean_docs(to_lines(docs), lines_per_block=8).collect()} == want
    for name in ("blocks", "items", "texts"):
        assert {r.doc_id for r in stored[name].select("doc_id").collect()} == {77}
