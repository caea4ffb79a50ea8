"""Word lists, tables and patterns that results depend on."""

from __future__ import annotations

# --- fixed values: severity order ---
SEVERITY_RANK = {"Critical": 4, "High": 3, "Medium": 2, "Low": 1, "Info": 0}

# --- fixed values: indicators ---
URL_RE = r"https?://[^\s\"'<>]{4,300}"
EMAIL_RE = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
API_RE = r"/(?:api|v[0-9]+|rest)/[a-zA-Z0-9_/\-{}]{2,100}"
# a dotted quad with no ASCII letter, digit or underscore on either side; group 1 is the address
IPV4_RE = r"(?:^|[^0-9A-Za-z_])((?:[0-9]{1,3}\.){3}[0-9]{1,3})(?:[^0-9A-Za-z_]|$)"
BOILERPLATE_DOMAINS = (
    "w3.org", "xmlpull.org", "xmlsoap.org", "schemas.android.com", "gnu.org", "apache.org", "opensource.org", "creativecommons.org", "purl.org", "json-schema.org",
    "schemas.microsoft.com", "registry.npmjs.org", "pypi.org", "golang.org", "go.dev", "docs.python.org", "developer.android.com", "developer.apple.com", "github.com",
    "sourceforge.net", "localhost.localdomain",
)
PLACEHOLDER_EMAIL_DOMAINS = ("example.com", "example.org", "test.com", "domain.com", "email.com")
INTERNAL_PREFIXES = ("localhost", "127.0.0.1", "0.0.0.0")
INTERNAL_LABELS = ("dev", "development", "stage", "staging", "test", "testing", "internal", "corp", "local", "sandbox", "qa", "uat")
PRIVATE_IP_PREFIXES = ("10.", "192.168.", "169.254.")
PRIVATE_172_RE = r"^172\.(1[6-9]|2[0-9]|3[01])\."
VERSION_CONTEXT_RE = r"(?i)(?:version|fileversion|productversion|assemblyversion|schemaversion)\s*[:=]\s*[\"']?$"

# --- fixed values: entropy ---
ENTROPY_CANDIDATE_RE = r"[A-Za-z0-9+/_\-=]{20,}"
GUID_RE = r"^\{?[0-9a-fA-F]{8}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{12}\}?$"
B64_THRESHOLD, HEX_THRESHOLD, MIN_TOKEN, MAX_TOKEN = 4.3, 3.3, 20, 4096
BINARY_MAGICS_HEX = ("89504E47", "FFD8FF", "474946383761", "474946383961", "424D", "504B0304", "25504446", "00010000", "4F54544F", "1F8B08")

# --- fixed values: inventory rules ---
INVENTORY_RULES = (
    "binary-dependency-graph", "interesting-strings", "compiler-framework-detected", "crypto-usage-detected", "no-anti-debug-apis-detected", "certificate-chain-summary",
    "signature-timestamp-present", "acl-check-limited", "embedded-manifest-present", "electron-hardening-summary", "auto-update-endpoint", "expired-signing-certificate-timestamped",
)

# --- fixed values: configuration keys ---
CONFIG_CLASSES = {
    "auth-setting": ("password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "client_secret", "auth"),
    "database-setting": ("database", "db_", "jdbc", "dsn", "connection", "mongodb", "postgres", "mysql", "sqlite"),
    "tls-setting": ("ssl", "tls", "certificate", "cert", "verify", "ca_bundle"),
    "debug-setting": ("debug", "trace", "verbose", "dev_mode"),
    "logging-setting": ("log", "logging", "loglevel", "log_level"),
}

# --- fixed values: packers, obfuscators, version floors ---
PACKER_SECTIONS = ("UPX0", "UPX1", "UPX2", ".aspack", ".adata", ".themida", ".vmp0", ".vmp1", ".vmp2", ".enigma1", ".enigma2", ".petite", ".mpress", ".mpress1", ".nspack")
OBFUSCATOR_MARKERS = ("ConfusedBy", "ConfuserEx", "Eazfuscator", "SmartAssembly", "Dotfuscator", "Agile.NET", "Babel Obfuscator", "Crypto Obfuscator", ".NET Reactor", "Skater .NET", "Spices.Net")
ELECTRON_MIN_MAJOR, NSIS_MIN = 42, (3, 9)

# --- fixed values: file sets ---
SKIP_DIRS = (".git", "__pycache__", "node_modules", ".artiscope_cache")
MAX_FILE_BYTES, MAX_TEXT_BYTES = 100 * 1024 * 1024, 5 * 1024 * 1024
