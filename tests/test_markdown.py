import pytest
from pyspark.sql import functions as F

from doclake.functions import markdown as M

# One case per branch of a rule, written from the description of the rules.
CASES = [
    ("collapse_spaces", ["표  앞   글", "| a    b |", "> 인용   문", "    - 들여   쓴 것"],
     ["표 앞 글", "| a    b |", "> 인용 문", "    - 들여 쓴 것"]),
    ("tighten", ["서울 · 부산", "( 가 ) 나", "「 법령 」 제정", "' 99년", "don' t", "점 ･ 점"],
     ["서울·부산", "(가) 나", "「법령」 제정", "'99년", "don' t", "점･점"]),
    ("despace", ["대 한 민 국", "가 나 다", "푸 른  하 늘  아 래", "학교에 가 는 날 에", "눈 비 바 람 x"],
     ["대한민국", "가 나 다", "푸른 하늘 아래", "학교에 가는날에", "눈비바람 x"]),
    ("strip_private_glyphs", ["\ue001 첫째", "중간\uf8ff  끝", "\ue123"],
     ["첫째", "중간끝", ""]),
    ("leftover_symbols", ["문장 Ÿ 끝", "| ¡ |"],
     ["문장 • 끝", "| • |"]),
    ("normalize_depths", ["      - 깊은 첫째", "   - 얕은 둘째", "- 맨 앞", "    - 아래"],
     ["- 깊은 첫째", "- 얕은 둘째", "- 맨 앞", "  - 아래"]),
    ("normalize_depths", ["- 하나", "", "      - 둘", "# 새 장", "      - 셋"],
     ["- 하나", "", "  - 둘", "# 새 장", "- 셋"]),
    ("join_wrapped", ["- 앞의 일 및", "- 뒤의 일", "- 따로"],
     ["- 앞의 일 및 뒤의 일", "- 따로"]),
    ("join_wrapped", ["- 사과,", "  - 배", "- 감"],
     ["- 사과, 배", "- 감"]),
    ("merge_headings", ["## 7", "## 일정", "### 8.", "본문"],
     ["## 7 일정", "### 8.", "본문"]),
    ("merge_headings", ["# Ⅱ", "", "# 추진 경과"],
     ["# Ⅱ 추진 경과"]),
    ("fix_bullets", ["□ 바깥", "- □ 큰 항목", "- ○ 중간", "- ▪ 작은", "- 따라오는 것", "닫는 글", "- 처음"],
     ["□ 바깥", "- 큰 항목", "  - 중간", "    - 작은", "      - 따라오는 것", "닫는 글", "- 처음"]),
    ("fix_bullets", ["- ▷", "- ▪", "- 남은 것"],
     ["    - 남은 것"]),
    ("fix_bullets", ["설명", "* 참고 1", "- ** 참고 2"],
     ["설명", "", "\\* 참고 1", "", "\\*\\* 참고 2"]),
    ("fix_bullets", ["- l 엘 항목", "- ② 서수", "- ■ ■ 겹침"],
     ["- 엘 항목", "- ② 서수", "- 겹침"]),
    ("relevel_headings", ["## Ⅳ 장", "## 3 절", "## 나. 목", "## 이어짐"],
     ["# Ⅳ 장", "## 3 절", "### 나. 목", "#### 이어짐"]),
    ("relevel_headings", ["## 제목", "본문", "## 1-1. 체계", "## (2) 세부"],
     ["# 제목", "본문", "### 1-1. 체계", "#### (2) 세부"]),
    ("clean_markdown", ["## 6", "## 계  획", "- ○ 첫 일 및", "- 둘째 일", "서 울 특 별 시"],
     ["## 6 계 획", "- 첫일및둘째 일", "서울특별시"]),
    ("fix_bullets", ["", "", ""], ["", "", ""]),
    ("fix_bullets", ["- ㅇ", "- ㅇ"], [""]),
    ("clean_markdown", [""], [""]),
]


@pytest.mark.parametrize("rule,lines,expected", CASES, ids=[f"{c[0]}-{i}" for i, c in enumerate(CASES)])
def test_rule(spark, rule, lines, expected):
    df = spark.createDataFrame([("\n".join(lines),)], "text string")
    assert df.select(getattr(M, rule)(F.col("text"))).first()[0].split("\n") == expected


def test_null_text_stays_null(spark):
    df = spark.createDataFrame([(None,)], "text string")
    assert df.select(M.clean_markdown(F.col("text"))).first()[0] is None


@pytest.mark.parametrize("rule", ["strip_private_glyphs", "normalize_depths", "tighten", "leftover_symbols", "collapse_spaces"])
def test_idempotent(spark, rule):
    from conftest import SMALL
    from doclake.plans.derived import raw_docs
    f = getattr(M, rule)
    once = raw_docs(spark, SMALL).select(f(F.col("text")).alias("t"))
    assert once.filter(f(F.col("t")) != F.col("t")).count() == 0


def test_partitioning_does_not_matter(spark):
    from conftest import SMALL
    from doclake.plans.derived import raw_docs
    docs = raw_docs(spark, SMALL)
    clean = M.clean_markdown(F.col("text")).alias("t")
    one, many = docs.coalesce(1).select("doc_id", clean), docs.repartition(13).select("doc_id", clean)
    assert one.exceptAll(many).count() == 0


def test_long_documents_stay_whole(spark):
    """Long runs and many lines must neither overflow the stack nor grow out of proportion."""
    n = 20_000
    texts = {
        "runs": "가 " * n + "끝",
        "items": "\n".join(f"{'  ' * (i % 7)}- 항목 {i}," for i in range(n)),
        "heads": "\n".join(f"## {i} 제목" for i in range(n)),
        "empty bullets": "- ㅇ\n" * n + "* 각주",
        "repeated symbol": "- " + "▪ " * n + "끝",
        "numbers": "## " + "1-" * n + "1\n## 제목",
        "blank run": "a" + " " * n + ")" + " " * n + "b",
        "table": "| a | b |\n" * n,
        "blank lines": "## 1\n" + "\n" * n + "## 끝",
        "one line": "- □ " + "낱말 " * n,
    }
    df = spark.createDataFrame(list(texts.items()), "k string, text string").repartition(8)
    out = {r.k: r.t for r in df.select("k", M.clean_markdown(F.col("text")).alias("t")).collect()}
    assert out["items"].count("\n") == 0 and out["items"].count("항목") == n
    assert out["heads"].split("\n") == [f"## {i} 제목" for i in range(n)]
    assert out["empty bullets"] == "\\* 각주"
    assert out["repeated symbol"] == "- 끝"
    assert out["blank run"] == "a) b"
    assert out["blank lines"] == "## 1 끝"
    assert out["table"] == texts["table"]
    assert out["one line"].startswith("- 낱말") and out["one line"].count("낱말") == n
    assert out["numbers"].endswith(" 제목") and "\n" not in out["numbers"]
    assert out["runs"].replace(" ", "") == texts["runs"].replace(" ", "")
