"""Operating limits and constants.

Fixed values: they bound what the operators return, so results only agree with
other implementations of the same rules while these stay as they are.
"""

# retrieval
RETRIEVAL_POOL = 50
RERANK_POOL = 50
FINAL_TOP_K = 7
RRF_K = 60
BM25_K1 = 1.2
BM25_B = 0.75
MODEL_BATCH = 32
EMBEDDING_DIM = 768
PASSAGE_PREFIX = "passage: "
QUERY_PREFIX = "query: "

# chunking
PARENT_TOKENS = 1024
CHILD_TOKENS = 256
CHILD_OVERLAP = 32
CHARS_PER_TOKEN = 5
TOKENS_PER_WORD = 1.33

# crawling
BOT_NAME = "docweirbot"
MAX_PAGES = 300
MAX_DEPTH = 3
DELAY_SECONDS = 1.5
REPO_FILE_CAP = 50
INDEX_MIN_LINES = 40
INDEX_LINK_RATIO = 0.1

# uploads and attachments
UPLOAD_MAX_BYTES = 10 * 1024 * 1024
ATTACHMENT_MAX_CHARS = 100 * 1024
ATTACHMENT_WARNING = "\n[WARNING: File truncated to 100KB limit]"

# conversations
MAX_INPUT_TOKENS = 12000
MAX_OUTPUT_TOKENS = 4096
HISTORY_LIMIT = 500
COMPACTION_THRESHOLD = 0.8
REFINEMENT_HISTORY = 5
PROMPT_MARGIN = 24
TOKEN_FACTOR = 1.35
IMAGE_TOKENS = 200
PAGE_SIZE = 20

# job polling
MAX_POLLS = 200
MAX_FAILURES_IN_A_ROW = 5
RUNNING_TTL_SECONDS = 600
FINISHED_TTL_SECONDS = 3600
