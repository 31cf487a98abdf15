"""Word lists and weights the functions and operators share."""

from __future__ import annotations

# Words that carry no meaning, by language.
STOPWORDS = {
    "en": "the and for with from this that are was were has have not all any can may must shall will should into out new get set add list item data name type value",
    "vi": "của và các cho một này đó là có không được khi với trong theo từ đến hoặc những đã sẽ phải cần",
    "de": "der die das und oder für mit von den dem des ein eine ist sind wird werden nicht auch auf aus bei",
    "th": "และ หรือ ของ ที่ ใน จะ ได้ เป็น การ ให้ กับ ไม่",
    "ko": "그리고 또는 에서 으로 하는 합니다 있는 없는 이다 위한",
    "ja": "および または する した こと ため これ それ です ます",
    "zh": "的 和 或 在 是 为 与 这 那 有 不",
    "es pt fr it": "que los las del por con para una uno como más dos das não são ser est sont pour dans avec sur les des une qui sono per con nel della delle",
    "id ms": "yang dan atau untuk dari pada dengan adalah akan tidak",
}
STOPWORD_LIST = sorted({w for words in STOPWORDS.values() for w in words.split()})

# What rules are about: terms, words that require, words that exempt.
SUBJECTS = {
    "approval": (
        "approval|approve|approved|authorisation|authorization|phê duyệt|duyệt|承認|승인|การอนุมัติ|อนุมัติ|genehmigung|freigabe|aprobación|approbation|aprovação|persetujuan",
        "require requires required need needs", "bypass skip exempt waive without"),
    "discount": ("discount|rebate|chiết khấu|giảm giá|割引|할인|ส่วนลด|rabatt|descuento|remise|desconto|diskon", "apply applies grant grants receive receives", "deny denies exclude excludes no"),
    "validation": (
        "validation|validate|kiểm tra|検証|검증|การตรวจสอบ|validierung|prüfung|validación|validação|validasi", "validate validates reject rejects block blocks", "allow allows permit permits ignore"),
    "credit limit": (
        "credit limit|hạn mức|与信限度|여신 한도|วงเงิน|kreditlimit|límite de crédito|limite de crédit|limite de crédito|batas kredit", "enforce enforces check checks block blocks", "override overrides ignore ignores"),
}
# Obligation and exemption words that hold for every subject.
REQUIRE_WORDS = "must|shall|mandatory|required|phải|cần|bắt buộc|muss|müssen|soll|erforderlich|debe|deben|obligatorio|doit|doivent|obligatoire|deve|devem|obrigatório|harus|wajib|ต้อง|จะต้อง|해야|필수|必须|必要".split("|")
BYPASS_WORDS = "exempt|exempted|waived|miễn|bỏ|qua|ausgenommen|befreit|exento|exempté|isento|dikecualikan|免除|면제|ยกเว้น".split("|")
# Obligation markers that make a sentence a candidate, for scripts with word boundaries and without.
MODAL_WORDS = (
    "must|shall|should|required to|may not|cannot|is required|are required|exempt|exempted|not required|no longer required|phải|không được|bắt buộc|được miễn|miễn|cần phải|muss|müssen|soll|sollen|darf nicht|erforderlich"
    "|verpflichtet|ausgenommen|befreit|debe|deben|deberá|obligatorio|exento|no puede|doit|doivent|obligatoire|exempté|ne peut pas|deve|devem|obrigatório|isento|harus|wajib|dikecualikan|tidak boleh"
)
MODAL_PARTS = "ต้อง|จะต้อง|ห้าม|ได้รับการยกเว้น|해야|하여야|필수|금지|면제|しなければならない|する必要|禁止|免除|必須|必须|应当|應當|需要"

# Words after FROM or JOIN that name no table.
NOT_TABLES = (
    "select where dual lateral unnest values set table only distinct all as on using inner outer left right full cross natural "
    "the a an this that these those it its my our your their his her list each any some which what here there them us me you we they he she"
).split()

# Language of a file by its extension.
EXTENSIONS = {
    "python": "py pyi", "typescript": "ts tsx", "javascript": "js jsx mjs cjs", "java": "java", "go": "go", "csharp": "cs", "rust": "rs", "ruby": "rb rake", "php": "php",
    "cpp": "cpp cc cxx hpp hh c h", "kotlin": "kt kts", "sql": "sql", "markdown": "md markdown mdx", "text": "txt rst adoc", "html": "html htm xhtml", "docx": "docx", "doc": "doc",
    "odt": "odt ott", "rtf": "rtf", "xlsx": "xlsx xlsm", "pptx": "pptx", "pdf": "pdf", "csv": "csv", "json": "json", "yaml": "yaml yml", "xml": "xml", "properties": "properties",
}
CODE_LANGUAGES = "python typescript javascript java go csharp rust ruby php cpp kotlin sql".split()
DOC_LANGUAGES = "markdown text html docx doc odt rtf xlsx pptx pdf".split()
# Folders and name endings that are not indexed, and the size above which files are skipped.
EXCLUDED_FOLDERS = ".git .quarrylens node_modules target dist build vendor __pycache__ .venv venv .tox .mypy_cache .pytest_cache site-packages .next coverage .idea .vscode".split()
EXCLUDED_SUFFIXES = ".min.js .min.css .map .lock .bundle.js -lock.json .pb.go _pb2.py .g.dart .generated.ts".split()
MAX_FILE_BYTES = 2 * 1024 * 1024
# Marks of documents that tell history instead of specifying.
HISTORICAL_MARKS = "change_log changelog changes release_note release-note releasenotes /news history.md whatsnew migration".split()

# How much relevance an edge passes on.
EDGE_WEIGHTS = {
    "CALLS": 0.75, "IMPORTS": 0.35, "INHERITS": 0.70, "READS": 0.65, "WRITES": 0.75, "DOCUMENTED_BY": 0.85, "MAPS_TO": 0.90, "INTRODUCED_BY": 0.45, "CHANGED_BY": 0.30,
    "CO_CHANGES_WITH": 0.40, "TESTED_BY": 0.60, "IMPLEMENTS_RULE": 0.95, "CONTRADICTS": 0.95,
}
SPREAD_KINDS = "CALLS INHERITS READS WRITES DOCUMENTED_BY MAPS_TO TESTED_BY IMPLEMENTS_RULE CONTRADICTS".split()
# Strength of a status, weakest first; of a rule's source.
STATUS_ORDER = "UNKNOWN ASSUMED CONFLICTED INFERRED OBSERVED CONFIRMED".split()
RULE_STRENGTH = {"test": 0.9, "constraint": 0.9, "code_guard": 0.8, "error_message": 0.75, "code_doc": 0.72, "document": 0.7}
NODE_KINDS = "File Symbol DocSection Concept Commit DatabaseObject BusinessRule".split()
