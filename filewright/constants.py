"""Names, messages and limits shared by every operator.

Fixed values: verdict names, method names, messages, routes and limits. Results
are compared with existing plans and logs, so the texts must stay as they are.
"""

UNKNOWN = "Unknown_Unsorted"
JUNK = "System_Junk"
ARCHIVES = "Archives_and_Apps"

METHOD_MARKER = "Rules (HC)"
METHOD_RULES = "Rules"
METHOD_MODEL = "Local AI"
METHOD_PREFILTER = "Prefilter"
METHOD_NONE = "None"
METHOD_QUEUE_PREFIX = "Queue:"

CONFIDENCE_MARKER = 100
CONFIDENCE_JUNK = 100
CONFIDENCE_KEYWORD = 95
CONFIDENCE_ARCHIVE = 75
DEFAULT_CONFIDENT = 80
DEFAULT_ACCEPT = 60

REASON_NO_STAGE = "No classifier matched"
REASON_NO_RULE = "No rule matched"
REASON_JUNK = "System/Hidden file detected by extension"
REASON_PREFILTER = "no worker can read this file type and no rule matched"
REASON_EMPTY_REPLY = "Ollama returned an empty string"
REASON_BAD_JSON = "AI returned invalid JSON"
REASON_NOT_OBJECT = "AI returned non-object JSON"
REASON_DEFAULT_REPLY = "AI classification"
REASON_TIMEOUT = "orchestrator timeout waiting for worker"
REASON_MALFORMED = "worker returned malformed classification"

ROUTE_SMALL = "ai-small"
ROUTE_LARGE = "ai-large"
ROUTE_IMAGE = "ocr"
ROUTE_NONE = "unroutable"
ROUTE_RULES = "rules"

LARGE_FILE_BYTES = 2 * 1024 * 1024
READABLE_EXTS = [".pdf", ".docx", ".txt", ".md", ".csv", ".rtf", ".html", ".eml", ".json", ".xml", ".log"]
IMAGE_EXTS = [".png", ".jpg", ".jpeg", ".tif", ".tiff", ".bmp"]
TEXT_EXTS = [".txt", ".log", ".json", ".xml", ".md", ".html", ".eml"]

SNIPPET_CHARS = 1000
PREVIEW_ROWS = 2
PAGES_PER_DOC = 3
PARAGRAPHS_PER_DOC = 30
PREFIX_KEYWORD_LEN = 5

BATCH_TIMEOUT_SECONDS = 300
RUN_TIMEOUT_SECONDS = 900
PROGRESS_TICK_SECONDS = 5
MAX_ATTEMPTS = 3

KEEP, LEAVE, REVIEW = "keep", "leave", "review"

# Ours: prefix of the engine's own bookkeeping files, skipped by every listing.
BOOKKEEPING_PREFIX = ".filewright"
