"""Limits, messages and token lists that results depend on."""

# --- fixed values: limits ---------------------------------------------------
MAX_BYTES = 100 * 1024 * 1024
MAX_PAGES = 500
MAX_QUEUED_PER_SESSION = 20
MIN_TEXT_CHARS = 10
SEC_PER_PAGE = 1.5
RETENTION_SEC = 86_400
PROBE_PAGES = 12
CONVERTER_REV = 7
MAX_ATTEMPTS = 1
LIST_LIMIT = 200

# --- fixed values: user-visible messages ------------------------------------
REJECT_MESSAGES = {
    "too_big": "파일이 100MB를 초과합니다",
    "not_pdf": "PDF 파일이 아닙니다",
    "over_quota": "대기 잡이 너무 많습니다(최대 20)",
    "broken": "PDF를 열 수 없습니다(손상되었거나 암호로 보호된 파일)",
    "empty": "페이지가 없는 PDF입니다",
    "too_many_pages": "500페이지를 초과합니다",
    "no_text": "텍스트 레이어가 없습니다 — 스캔본(이미지) PDF는 OCR 미지원",
}
STALE_OPTIONS_MESSAGE = "변환기가 업데이트되었습니다. 다시 업로드해 주세요."
POISON_MESSAGE = ("문서가 너무 무거워 변환하지 못했습니다. 페이지에 이미지·도형이 "
                  "과도하게 많으면 메모리 한도를 넘길 수 있습니다.")
LABEL_DONE = "완료"
LABEL_FAILED = "실패"
LABEL_STARTING = "곧 시작"
LABEL_AHEAD = ("앞에 ", "개 대기")

# --- fixed values: Markdown token lists -------------------------------------
BULLETS_BY_DEPTH = (
    "□ㅁ■◇◆",            # depth 0
    "ㅇ○◦●▷▶¡Ÿ",         # depth 1
    "▪-\u00ad",           # depth 2 (the last one is the soft hyphen)
)
ORDINAL_STARTS = "①-⑳→⇒⇨"
ROMAN_NUMERALS = "Ⅰ-Ⅹ"
UNFINISHED_ANYWHERE = ("[,，·･]", "적인", "하여", "되어")
UNFINISHED_WORDS = ("및", "또는", "혹은", "그리고", "위한", "대한", "관한", "따른", "의한", "통한",
                    "이", "가", "을", "를", "의", "에", "와", "과", "로", "으로")
CONTINUATION_ENDINGS = ("하여", "하고", "하는", "한다", "되어", "되고", "되는", "된다")
CONTINUATION_WORDS = ("등", "및", "또는")
MIDDLE_DOTS = "·‧⸱・･"
OPENING_BRACKETS = "｢「『（(["
CLOSING_BRACKETS = "｣」』）)]"
LEFTOVER_SYMBOLS = "¡Ÿ"
LEFTOVER_REPLACEMENT = "•"
IMAGE_PLACEHOLDER = "<!-- image -->"

# --- fixed values: patterns ---------------------------------------------------
# a heading that holds a number alone, without its white space
NUMBER_ALONE = rf"(?:[{ROMAN_NUMERALS}]+|\d+(?:[-–.]\d+)*+\.?|[가-힣][.)])"
# heading level by the start of the title; bullets of depth 0, 1, 2 give levels 2, 3, 4
LEVEL_BY_START = (
    (1, rf"^[{ROMAN_NUMERALS}]"),
    (3, r"^\d+ *[-–] *\d+"),
    (3, r"^[가-힣][.)] "),
    (2, r"^(?:제 *)?\d+[.장절]?(?: |$)"),
)
# characters that a folder name must not hold
UNSAFE_IN_NAMES = r'[\\/:*?"<>|]'
# the text whose hash names the options of a job
OPTIONS_FORMAT = ("rev=", ";img=", ";csv=")

# Unicode's white space and the four separators of ASCII: what is stripped from a page.
WHITE_SPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B)))
               + "\u2028\u2029\u202f\u205f\u3000")
