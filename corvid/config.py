"""Constants of the retrieval engine. Sizes, weights, ranks and marks that results depend on."""

MIN_CHARS, MAX_CHARS = 200, 4000
BODY_CHARS, WINDOW_RADIUS, MAX_WINDOWS, TOP_SECTIONS = 8000, 1750, 3, 8
APPENDIX_FACTOR, PATH_LIMIT, RRF_K = 0.3, 30, 60
SUMMARY_CHARS, FLAT_GUARD = 400, 400
K1, B = 1.2, 0.75
#: Columns of the index and their weights; the others are not indexed.
WEIGHTS = {"report_title": 5.0, "chapter": 2.0, "section": 2.0, "summary": 3.0, "body": 1.0, "body_fold": 1.0, "lead_researcher": 1.0, "institution": 1.0}
MARK_HEAD, MARK_MIDDLE, MARK_TAIL = "…(전략)…", "…(중략)…", "…(후략)…"
SECTION_ID = r"(?U)[\w-]+_c\d+(?:s\d+)*"
STAMPS = ("verified_register", "verified_extract", "verified_annotate")
TITLE_STOP = ["연구", "보고서", "최종", "최종보고서", "방안", "위한", "대한", "분석", "개발", "정책", "정책연구", "사업", "지원", "체계", "구축", "마련", "전략", "기획", "개선", "관한", "통한"]
UNIT_SUMMARY, REPORT_SUMMARY = "> **요약:** ", "> **보고서 요약:** "
HEADING = r"(?d)^(#{1,4}) (.*?) <!-- id: ([^>]+?) -->\z"
#: Glyphs that folding for comparison drops.
GLYPHS = "□○ㅇ❍◉▸▪‣∙•Ÿ-–|\\"
