"""Word lists, patterns, labels and limits that results must match exactly.

Patterns are written with ``\\d`` and ``\\s`` in their Unicode meaning; ``functions.text.unicode_regex``
turns them into classes that Java and RE2 read the same way.
"""

# ---- text ------------------------------------------------------------------------------------
LANGUAGE_INDICATORS = ["el ", "la ", "de ", "que ", "y ", "a ", "en ", "un ", "es ", "se "]
LANGUAGE_MIN_HITS = 5  # more than this many distinct indicators means "es"

METRIC_PATTERNS = {
    "percent": r"(\d+(?:\.\d+)?%)",
    "money": r"(\$\d+(?:,\d{3})*(?:\.\d{2})?)",
    "big_number": r"(\d+(?:,\d{3})*\s*(?:millones?|millions?|mil|thousand))",
    "duration": r"(\d+(?:\.\d+)?\s*(?:años?|years?|meses?|months?))",
}
MAX_METRICS_SHOWN = 10

SECTION_KEYWORDS = {
    "summary": ["resumen", "summary", "executive"],
    "recommendations": ["conclusión", "conclusion", "recomendación", "recommendation"],
    "metrics": ["métrica", "metric", "kpi", "resultado", "result"],
}

SUMMARY_LINES = 5
SUMMARY_MIN_LENGTH = 10
SUMMARY_MAX_LENGTH = 500
SUMMARY_SKIP_PREFIXES = ["---", "```", "#"]

HEADING_MAX_LENGTH = 100
HEADING_NUMBERED = r"^\d+\.?\s+"
HEADING_CAPITAL = r"^[A-Z][^.!?]*$"
LIST_PATTERNS = [r"^\s*[-*•]\s+", r"^\s*\d+\.?\s+", r"^\s*[a-zA-Z]\.?\s+"]
MAX_HEADINGS_SHOWN = 10
PARAGRAPH_MIN_LENGTH = 50

AI_SUMMARY_TITLE = "## 🎯 AI Summary"
AI_METRICS_TITLE = "## 📊 Key Metrics"
AI_SECTION_TITLES = {
    "summary": "## 📋 Executive Summary",
    "metrics": "## 📈 Performance Metrics",
    "recommendations": "## 💡 Recommendations",
}
AI_CONTENT_TITLE = "## 📖 Full Document Content"
AI_FOOTER = "\n\n---\n*Document processed and optimized for AI analysis*"

TEXT_TITLE = "## 📄 Text Document Analysis"
TEXT_STRUCTURE_TITLE = "### 🗂️ Detected Structure"
TEXT_LISTS_TITLE = "### 📋 Detected Lists"
TEXT_CONTENT_TITLE = "### 📖 Document Content"

# ---- routing ---------------------------------------------------------------------------------
# extension, reader, document type, fence language, what happens when the content cannot be parsed
READERS = [
    ("default", "text", "text_document", "text", "reject"),
    ("txt", "text", "text_document", "text", "reject"),
    ("csv", "csv", "csv_dataset", None, "reject"),
    ("json", "json", "json_data", "json", "reject"),
    ("xml", "xml", "xml_document", "xml", "raw_text"),
    ("msgflow", "xml", "xml_document", "xml", "raw_text"),
    ("project", "xml", "xml_document", "xml", "raw_text"),
    ("descriptor", "xml", "xml_document", "xml", "raw_text"),
    ("yaml", "yaml", "yaml_config", "yaml", "raw_text"),
    ("yml", "yaml", "yaml_config", "yaml", "raw_text"),
    ("xlsx", "excel", "excel_workbook", None, "error_document"),
    ("xls", "excel", "excel_workbook", None, "error_document"),
    ("xlsm", "excel", "excel_workbook", None, "error_document"),
    ("docx", "docx", "docx_document", None, "error_document"),
]
REFUSED_EXTENSIONS = ["pdf", "bar"]
OUTPUT_FORMATS = ["markdown", "markdown_ai", "plain", "structured_json"]
DEFAULT_OUTPUT_FORMAT = "markdown"
DEFAULT_MAX_CHUNK_SIZE = 4000

# object-store error code and message template
OBJECT_ERRORS = [
    ("NoSuchBucket", "S3 bucket '{bucket}' does not exist or you don't have access"),
    ("NoSuchKey", "File '{key}' not found in bucket '{bucket}'"),
    ("AccessDenied", "Access denied to s3://{bucket}/{key}. Check your permissions"),
    ("InvalidBucketName", "Invalid bucket name: '{bucket}'"),
    ("PermanentRedirect", "Bucket '{bucket}' is in a different region"),
    ("SlowDown", "S3 is throttling requests. Please retry later"),
]

SUCCESS_MESSAGE = "Archivo procesado exitosamente"
CLIENT_ERROR_TYPE = "ErrorValidacion"
SUPPORTED_FORMATS_TEXT = [
    "PDF (.pdf) - Condicional", "Word (.docx)", "Excel (.xlsx, .xls, .xlsm)", "CSV (.csv)",
    "JSON (.json)", "XML (.xml)", "YAML (.yaml, .yml)", "Texto (.txt)",
]
CLIENT_HINTS = [
    "Verifique que todos los parámetros requeridos estén presentes",
    "Asegúrese de que el formato de salida sea válido",
    "Para S3: verifique que la ruta tenga formato s3://bucket/archivo",
    "Para base64: verifique que el contenido esté correctamente codificado",
]
SERVER_HINTS = [
    "Verifique que el archivo no esté corrupto",
    "Asegúrese de que el archivo sea de un formato soportado",
    "Para archivos grandes, intente procesarlos por partes",
    "Contacte al soporte técnico si el problema persiste",
]
# reject reason, status, message
REJECT_MESSAGES = [
    ("missing_file_name", 400, "Falta el parámetro requerido: 'file_name'"),
    ("no_source", 400, "Debe proporcionar 'file_content' (base64) o 's3_path'"),
    ("two_sources", 400, "No puede proporcionar tanto 'file_content' como 's3_path'. Elija un método de entrada"),
    ("bad_output_format", 400, "Formato de salida inválido"),
    ("missing_bucket", 400, "Formato de ruta S3 inválido"),
    ("bad_base64", 400, "Contenido base64 inválido"),
    ("empty_content", 400, "El contenido del archivo decodificado está vacío"),
    ("missing_file", 400, "Archivo no encontrado"),
    ("unreadable_file", 400, "El archivo no es legible"),
    ("empty_file", 400, "El archivo está vacío"),
    ("no_extension", 400, "El archivo no tiene extensión"),
    ("unsupported_extension", 400, "Extension no soportada"),
    ("invalid_utf8", 400, "Falló al procesar archivo"),
    ("malformed", 400, "Falló al procesar archivo"),
    ("internal_error", 500, "Ocurrió un error interno al procesar el archivo"),
]

# ---- datasets --------------------------------------------------------------------------------
DATE_PATTERNS = [r"\d{4}-\d{2}-\d{2}", r"\d{2}/\d{2}/\d{4}", r"\d{2}-\d{2}-\d{4}"]
TYPE_SAMPLE_ROWS = 5
PREVIEW_ROWS = 10

# ---- trees -----------------------------------------------------------------------------------
COMPLEX_DEPTH, COMPLEX_KEYS = 4, 50
MODERATE_DEPTH, MODERATE_KEYS = 2, 10
OUTLINE_KEYS = 5
OUTLINE_DEPTH = 3
OUTLINE_PREVIEW = 30
CONFIG_KEY_DEPTH = 2
CONFIG_PATTERNS = [
    ("database", ["host", "port", "user", "password", "name"]),
    ("server", ["host", "port", "ssl", "timeout"]),
    ("api", ["url", "key", "token", "endpoint"]),
    ("logging", ["level", "format", "file", "handlers"]),
    ("cache", ["ttl", "size", "type", "redis"]),
    ("security", ["secret", "key", "token", "auth"]),
    ("docker", ["image", "ports", "volumes", "env"]),
    ("kubernetes", ["replicas", "image", "service", "ingress"]),
]

# ---- grids -----------------------------------------------------------------------------------
SHEET_ROW_LIMIT = 1000
CENSUS_ROWS, CENSUS_COLUMNS, CENSUS_CELLS = 20, 10, 100
CELL_KINDS = ["text", "number", "date", "boolean", "empty"]
DATE_INDICATORS = ["-", "/", ":", "T", "202", "201", "199"]
DATE_MIN_LENGTH = 6
HEADER_RATIO = 0.6
HEADER_COLUMNS = 12
HEADER_CELL_LENGTH, BODY_CELL_LENGTH = 150, 120
PLAIN_ROWS = 50
FORMULA_ROWS, FORMULA_COLUMNS, FORMULA_HITS = 100, 50, 10
MARKDOWN_SPECIALS = ["\\", "|", "*", "_", "#", "`", "[", "]", "~"]

# ---- markdown --------------------------------------------------------------------------------
TITLE_LEVEL_ONE = ["INTRODUCCIÓN", "DESCRIPCIÓN", "ESPECIFICACIÓN"]
PROMOTE_SPECIALS = r"[{}()\[\]\"|:]"
CODE_BLOCK_LINES = 50
MAX_HEADER_LEVEL = 6
TOC_TITLE = "## Contenido"
TOC_ENTRY = r"^\[.*\]\(#.*\)$"
SIMPLE_BLOCK_LENGTH = 50
COMPLEX_CODE = ["{", "}", "[", "]", ":", "=", "=>", "->", "&&", "||"]
TABLE_HEADERS = [r"__[^_]+__.*__[^_]+__", r"\*[^*]+\*.*\*[^*]+\*"]
UNDERLINED, STARRED = r"__([^_]+)__", r"\*([^*]+)\*"
SEPARATOR_MARKS = ["---", ":-:", ":--"]
BARE_URL = r"(?<![\[\(])(https?://[^\s<>\)]+)(?![\]\)])"
SPACED_LINK = r"\[([^\]]+)\]\s*\(([^)]+)\)"
CODE_STARTS = [
    r"^\s*[\{\[]",
    r"^\s*<[a-zA-Z][^>]*>",
    r"^(POST|GET|PUT|DELETE|PATCH|HEAD|OPTIONS)\s+/",
    r"^HTTP/[0-9]\.[0-9]",
    r"^[A-Za-z][-\w]*:\s+.+",
    r'^\s*"[^"]+"\s*:\s*',
]
CODE_HTTP = r"^(POST|GET|PUT|DELETE|PATCH)\s+"
DOC_TITLE = "## 📝 Word Document Analysis"
LINT_COLUMNS = "Inconsistencia en número de columnas de tabla"
LINT_PIPES = "Tabla con formato incorrecto (pipes insuficientes)"
LINT_LEVEL = "Header nivel {level} no válido (máximo 6)"
LINT_SPACE = "Falta espacio después de # en header"
LINT_FENCE = "Bloque de código mal formado"
