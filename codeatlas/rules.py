"""Rule tables.

Everything between the FIXED VALUES markers is data that must equal the
analysed tool's behaviour for results to match (names, keyword lists, labels,
thresholds). They are kept here as plain literals, in their natural order, and
turned into Column expressions or small dimension DataFrames elsewhere.
"""

from __future__ import annotations

# ----------------------------------------------------------------------------
# FIXED VALUES (must match the analysed tool's rules)
# ----------------------------------------------------------------------------

MAX_FILE_SIZE = 10 * 1024 * 1024

SKIP_DIRS = ("__pycache__", ".venv", "venv", ".git", "node_modules",
             ".tox", ".mypy_cache", ".pytest_cache", ".eggs", "dist", "build")

# Method-call classification (ordered rules, first match wins).
API_METHODS = ("get", "post", "put", "patch", "delete", "head", "options", "request")
API_OBJECTS = ("requests", "httpx", "client", "session", "http", "aiohttp")
SERIALIZATION_METHODS = ("dump", "load", "reader", "writer", "DictReader", "DictWriter")
FILE_IO_MODULES = ("json", "csv", "pickle", "yaml", "toml")
PATHLIB_IO_METHODS = ("read_text", "write_text", "read_bytes", "write_bytes")
DB_METHODS = ("execute", "executemany", "fetchone", "fetchall", "fetchmany",
              "commit", "rollback", "cursor",
              "insert_one", "insert_many", "find", "find_one", "update_one", "delete_one",
              "query", "add", "flush")
DB_OBJECTS = ("cursor", "cur", "conn", "connection", "db", "database",
              "session", "engine", "collection", "table", "query")
LOGGING_METHODS = ("info", "debug", "warning", "error", "critical", "exception")
LOGGING_OBJECTS = ("logging", "logger", "log")
TRANSFORM_METHODS = ("replace", "split", "join", "strip", "lstrip", "rstrip",
                     "lower", "upper", "title", "encode",
                     "append", "extend",
                     "loads", "dumps")
# Bare-name calls.
OUTPUT_NAMES = ("print",)
FILE_IO_NAMES = ("open",)
TRANSFORM_BUILTINS = ("sorted", "map", "filter", "zip", "enumerate",
                      "int", "str", "float", "list", "dict", "set", "tuple",
                      "len", "sum", "min", "max")

# Import prefix -> (service name, icon). Longest matching prefix wins.
SERVICE_MAP = (
    ("openai", "OpenAI", "openai"),
    ("anthropic", "Anthropic", "anthropic"),
    ("cohere", "Cohere", "cohere"),
    ("replicate", "Replicate", "replicate"),
    ("huggingface_hub", "Hugging Face", "huggingface"),
    ("transformers", "Hugging Face Transformers", "huggingface"),
    ("litellm", "LiteLLM", "litellm"),
    ("langchain", "LangChain", "langchain"),
    ("gspread", "Google Sheets", "google-sheets"),
    ("google.oauth2", "Google Auth", "google"),
    ("google.cloud.storage", "Google Cloud Storage", "gcs"),
    ("google.cloud.bigquery", "BigQuery", "bigquery"),
    ("googleapiclient", "Google API", "google"),
    ("googlemaps", "Google Maps", "google-maps"),
    ("boto3", "AWS", "aws"),
    ("botocore", "AWS", "aws"),
    ("sqlalchemy", "SQL Database", "database"),
    ("pymongo", "MongoDB", "mongodb"),
    ("redis", "Redis", "redis"),
    ("psycopg2", "PostgreSQL", "postgresql"),
    ("sqlite3", "SQLite", "sqlite"),
    ("supabase", "Supabase", "supabase"),
    ("requests", "HTTP Client", "http"),
    ("httpx", "HTTP Client", "http"),
    ("aiohttp", "HTTP Client", "http"),
    ("urllib3", "HTTP Client", "http"),
    ("slack_sdk", "Slack", "slack"),
    ("twilio", "Twilio", "twilio"),
    ("sendgrid", "SendGrid", "sendgrid"),
    ("telegram", "Telegram", "telegram"),
    ("discord", "Discord", "discord"),
    ("selenium", "Selenium", "selenium"),
    ("playwright", "Playwright", "playwright"),
    ("scrapy", "Scrapy", "scrapy"),
    ("beautifulsoup4", "BeautifulSoup", "bs4"),
    ("bs4", "BeautifulSoup", "bs4"),
    ("apify_client", "Apify", "apify"),
    ("dropbox", "Dropbox", "dropbox"),
    ("paramiko", "SSH/SFTP", "ssh"),
    ("stripe", "Stripe", "stripe"),
    ("celery", "Celery", "celery"),
    ("apscheduler", "APScheduler", "scheduler"),
    ("schedule", "Schedule", "scheduler"),
    ("fastapi", "FastAPI", "fastapi"),
    ("flask", "Flask", "flask"),
    ("django", "Django", "django"),
    ("modal", "Modal", "modal"),
)

# Step type labels: (type, business, technical, technical short, flow-node prefix, compact label).
TYPE_LABELS = (
    ("api_call", "External Service", "API Call", "API", "API: ", "API"),
    ("file_io", "Read/Write File", "File I/O", "File", "File: ", "File I/O"),
    ("db_op", "Database", "Database", "DB", "DB: ", "DB"),
    ("decision", "Check", "Decision", "Decision", "", "Decision"),
    ("output", "Log/Notify", "Output", "Output", "Output: ", "Output"),
    ("transform", "Data Processing", "Transform", "Transform", "Transform: ", "Transform"),
)

# Phases in display order: (phase, label).
PHASES = (
    ("setup", "Setup & Data Gathering"),
    ("processing", "Data Processing"),
    ("storage", "Storage & Delivery"),
    ("error_handling", "Error Handling"),
    ("reporting", "Reporting"),
)

STORAGE_KEYWORDS = (".post(", ".put(", ".patch(", ".delete(",
                    "send(", ".dump(", ".to_csv", ".to_json", ".to_excel",
                    ".write(", ".write_text(", "'w'", '"w"',
                    ".insert(", ".add(", ".commit(", ".create(", ".save(", ".update(")
SETUP_KEYWORDS = ("authorize(", "authenticate(", "connect(",
                  ".load(", ".read_csv", ".read_json", ".read_excel",
                  ".read(", ".read_text(", "'r'", '"r"',
                  "open(", ".get(")

# api_call verbs by case-sensitive substring, else "Fetches data from".
API_VERBS = ((".post(", "Sends data to"),
             (".put(", "Updates data on"),
             (".patch(", "Updates data on"),
             (".delete(", "Removes data from"),
             ("authorize(", "Authenticates with"))
FILE_WRITE_SIGNALS = (".dump(", ".to_csv", ".to_json", ".to_excel",
                      ".write(", ".write_text(", "'w'", '"w"')
FILE_READ_SIGNALS = (".load(", ".read_csv", ".read_json", ".read_excel",
                     ".read(", ".read_text(", "'r'", '"r"')
DB_WRITE_SIGNALS = (".insert", ".add(", ".commit(", ".update(", ".create(", ".save(")
# Transform labels, first matching rule wins.
TRANSFORM_RULES = (
    (("list comprehension", "dict comprehension", "set comprehension"), "Builds a collection of items"),
    ((".split(",), "Splits text into parts"),
    ((".join(",), "Joins text together"),
    ((".strip(", ".lower(", ".upper(", ".replace("), "Cleans up text"),
    (("sorted(",), "Sorts data"),
    (("int(", "float(", "str("), "Converts data type"),
    (("len(",), "Counts items"),
    ((".encode(", ".decode("), "Converts text encoding"),
    ((".loads(", ".dumps("), "Converts data format"),
)

CRON_PATTERNS = (("* * * * *", "Runs every minute"),
                 ("0 * * * *", "Runs every hour"),
                 ("0 0 * * *", "Runs daily at midnight"),
                 ("0 0 * * 0", "Runs weekly on Sunday"),
                 ("0 0 1 * *", "Runs monthly"))

SECRET_PREFIXES = (("AWS_", "AWS"), ("GOOGLE_", "Google"), ("OPENAI_", "OpenAI"),
                   ("ANTHROPIC_", "Anthropic"), ("APIFY_", "Apify"), ("SLACK_", "Slack"),
                   ("PANDADOC_", "PandaDoc"), ("INSTANTLY_", "Instantly"), ("STRIPE_", "Stripe"),
                   ("TWILIO_", "Twilio"), ("SENDGRID_", "SendGrid"), ("GITHUB_", "GitHub"),
                   ("GITLAB_", "GitLab"), ("AZURE_", "Azure"), ("HF_", "Hugging Face"),
                   ("HUGGINGFACE_", "Hugging Face"))
SECRET_SUFFIXES = ("_API_KEY", "_TOKEN", "_SECRET", "_CREDENTIALS", "_PASSWORD")

CONNECTION_VERBS = (("import", "uses"), ("file_io", "shares data with"),
                    ("subprocess", "launches"), ("trigger", "triggers"))

# Route decorator markers and the HTTP methods looked for, in order.
ROUTE_MARKERS = (".get(", ".post(", ".put(", ".delete(", ".patch(", ".route(")
ROUTE_METHODS = ("get", "post", "put", "delete", "patch")
WEBHOOK_METHOD_PREFIXES = ("POST ", "GET ", "PUT ", "DELETE ", "PATCH ")

# Thresholds.
PRINT_SPAM_MIN = 3          # more than this many print steps
TRY_BULK_MIN = 5            # more than this many try blocks
NO_ERROR_MIN_STEPS = 10     # more than this many steps
TRANSFORM_HEAVY_MIN = 15    # more than this many identical transforms
PHASE_DOMINANCE = 0.5       # phase share strictly above
PHASE_SHARE_SHOWN = 40      # integer percent strictly above
PRINT_EXCESS = 10           # pattern insight critique above
TRY_EXCESS = 5              # pattern insight critique above
COMPACT_THRESHOLD = 8       # function collapses above this many steps
COMPACT_TOP_TYPES = 4
CONDITION_MAX = 60
STEP_BONUS_PER = 20
STEP_BONUS_CAP = 5
KEY_SCRIPT_DIVISOR = 3
FIRST_TYPES_SHOWN = 4
PROMPT_IO_MAX = 10

# ----------------------------------------------------------------------------
# END FIXED VALUES
# ----------------------------------------------------------------------------
