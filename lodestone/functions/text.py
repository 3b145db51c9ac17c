"""Column functions over code and text: tokens, identifiers, paths, secrets. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: words that carry no meaning in code
STOP_WORDS = "the a an is are was were be been to of in for on with at by from if then else do while this that it let var const mut pub fn def class return true false null none nil self".split()

# fixed values: groups of words that stand for each other; of a word in two groups the later group counts
SYNONYM_GROUPS = """
func function fn def method proc procedure
struct structure class type record
err error exception failure fault
ok success result
str string text
int integer number num
bool boolean flag
arr array list vec vector slice
dict dictionary map hashmap hash
cfg config configuration settings options
msg message payload
req request
res resp response
db database store storage
auth authentication authorize
impl implement implementation
init initialize setup create new
del delete remove drop
get fetch retrieve read load
set update write save store
async asynchronous concurrent
sync synchronous blocking
"""

# fixed values: parts of paths that point to secrets
SENSITIVE = ".env .pem .key .p12 .pfx credentials secrets .htpasswd id_rsa id_dsa id_ecdsa id_ed25519 .npmrc .pypirc .netrc aws_access gcloud keystore".split()

# fixed values: file suffixes and languages
LANGUAGES = {"rs": "rust", "py": "python", "pyi": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "ts": "typescript", "tsx": "tsx", "go": "go", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "java": "java", "cs": "csharp", "sh": "bash", "bash": "bash", "rb": "ruby", "kt": "kotlin", "kts": "kotlin", "php": "php", "swift": "swift", "scala": "scala", "lua": "lua", "yaml": "yaml", "yml": "yaml", "json": "json", "toml": "toml", "md": "markdown", "tf": "terraform"}


def synonyms() -> dict[str, list[str]]:
    found: dict[str, list[str]] = {}
    for line in SYNONYM_GROUPS.split("\n"):
        group = line.split()
        for word in group:
            found[word] = [w for w in group if w != word]
    return found


def tokenize(text: Column) -> Column:
    """Tokens of code: the parts of each identifier, then the identifier itself, in lower case, of two bytes or more, without stop words.

    A part ends before an upper-case letter that follows a lower-case one or precedes one, and at '_'. A plain lower-case
    word counts twice, as its only part and as the identifier. Null gives null.
    """
    idents = F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}_]+)"), 1)
    parts = F.transform(idents, lambda w: F.concat(F.split(w, r"_|(?<=\p{Ll})(?=\p{Lu})|(?<=[^_])(?=\p{Lu}\p{Ll})"), F.array(w)))
    low = F.transform(F.flatten(parts), F.lower)
    return F.filter(low, lambda t: (F.octet_length(t) >= 2) & ~t.isin(*STOP_WORDS))


WORDS = r"([\p{L}\p{N}_]+)"
PARTS = r"_|(?<=\p{Ll})(?=\p{Lu})|(?<=[^_])(?=\p{Lu}\p{Ll})"


def counted_tokens(docs: DataFrame, text: str = "text", key: str = "id") -> DataFrame:
    """(id, term, n): the tokens of tokenize(), a row for each identifier or part; a text without any gives one row with a null term and n 0.

    Identifiers are exploded first, so that splitting, lower case and stop words run in generated code; plain words, which count twice, are not split.
    """
    idents = docs.select(F.col(key).alias("id"), F.explode_outer(F.regexp_extract_all(F.col(text), F.lit(WORDS), 1)).alias("w"))
    compound = F.col("w").rlike(r"_|\p{Lu}")
    both = F.concat(F.split("w", PARTS), F.array("w"))
    terms = idents.select("id", F.explode_outer(F.when(compound, both).otherwise(F.array("w"))).alias("t"), F.when(compound, 1).otherwise(2).alias("n"))
    low = terms.select("id", F.lower("t").alias("t"), "n")
    real = F.col("t").isNotNull() & (F.octet_length("t") >= 2) & ~F.col("t").isin(*STOP_WORDS)
    return low.select("id", F.when(real, F.col("t")).alias("term"), F.when(real, F.col("n")).otherwise(0).alias("n"))


def trigrams(text: Column) -> Column:
    """Runs of three characters; the whole text if it is shorter."""
    return F.when(F.length(text) < 3, F.array(text)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - 2)), lambda i: F.substr(text, i, F.lit(3))))


def glob_regex(pattern: str) -> str:
    """A Java regex of a glob in which * and ? also match '/'."""
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else "\\" + c if c in r"\.^$+{}()|[]" else c for c in pattern) + "$"


# fixed values: folders and file names of test code
TEST_PATH = r"/(tests?|__tests__|fixtures|testdata|test_data|mocks|__mocks__|spec|test-fixtures|vulnerable)/|^test-fixtures/|/security/vulnerable"
TEST_NAME = r"(_tests?\.rs|\.(test|spec)\.(js|ts|jsx|tsx)|_test\.py|_test\.go|[^/]test\.java)$|(^|/)(test_|vulnerable\.|insecure\.)[^/]*$"


def is_test_file(path: Column) -> Column:
    low = F.lower(path)
    return low.rlike(TEST_PATH) | low.rlike(TEST_NAME)


def is_sensitive_file(path: Column) -> Column:
    return F.lower(path).rlike("|".join(s.replace(".", r"\.") for s in SENSITIVE))


def is_comment_line(line: Column) -> Column:
    return line.rlike(r"^\s*(//|\*|#)")


def language_of(path: Column) -> Column:
    suffix = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, suffix), F.lit("unknown"))


def entropy(text: Column) -> Column:
    """Shannon bits of the characters; shares are of the length in bytes. Empty gives 0."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.octet_length(text).cast("double")
    share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / n
    return F.when(F.length(text) == 0, F.lit(0.0)).otherwise(F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c))))


def redact_secret(text: Column) -> Column:
    """Stars for up to eight characters, else the first and last four."""
    return F.when(F.length(text) <= 8, F.repeat(F.lit("*"), F.length(text))).otherwise(F.concat(F.left(text, F.lit(4)), F.lit("..."), F.right(text, F.lit(4))))


# fixed values: forms of secrets in the order in which they are replaced, and what replaces them
REDACTIONS = [
    (r"(?i)(api[_-]?key|apikey)\s*[:=]\s*[\"']?([a-zA-Z0-9_-]{20,})[\"']?", "$1=[REDACTED]"),
    (r"(?i)(secret[_-]?key|secretkey)\s*[:=]\s*[\"']?([a-zA-Z0-9_-]{20,})[\"']?", "$1=[REDACTED]"),
    (r"(?i)(access[_-]?token|accesstoken)\s*[:=]\s*[\"']?([a-zA-Z0-9_-]{20,})[\"']?", "$1=[REDACTED]"),
    (r"(?i)(auth[_-]?token|authtoken)\s*[:=]\s*[\"']?([a-zA-Z0-9_-]{20,})[\"']?", "$1=[REDACTED]"),
    (r"AKIA[0-9A-Z]{16}", "[AWS_KEY_REDACTED]"),
    (r"(?i)aws[_-]?secret[_-]?access[_-]?key\s*[:=]\s*[\"']?([a-zA-Z0-9/+=]{40})[\"']?", "AWS_SECRET_ACCESS_KEY=[REDACTED]"),
    (r"ghp_[a-zA-Z0-9]{36}", "[GITHUB_TOKEN_REDACTED]"),
    (r"gho_[a-zA-Z0-9]{36}", "[GITHUB_OAUTH_REDACTED]"),
    (r"ghu_[a-zA-Z0-9]{36}", "[GITHUB_USER_TOKEN_REDACTED]"),
    (r"ghs_[a-zA-Z0-9]{36}", "[GITHUB_SERVER_TOKEN_REDACTED]"),
    (r"github_pat_[a-zA-Z0-9_]{22,}", "[GITHUB_PAT_REDACTED]"),
    (r"-----BEGIN (RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----[\s\S]*?-----END (RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----", "[PRIVATE_KEY_REDACTED]"),
    (r"(?i)(password|passwd|pwd)\s*[:=]\s*[\"']?([^\"'\s]{8,})[\"']?", "$1=[REDACTED]"),
    (r"(?i)bearer\s+[a-zA-Z0-9_=-]+\.[a-zA-Z0-9_=-]+\.?[a-zA-Z0-9_=-]*", "Bearer [JWT_REDACTED]"),
    (r"(?i)(mongodb|postgres|mysql|redis)://[^@]+@", "$1://[CREDENTIALS_REDACTED]@"),
    (r"xox[baprs]-[0-9]{10,13}-[0-9]{10,13}[a-zA-Z0-9-]*", "[SLACK_TOKEN_REDACTED]"),
    (r"sk_live_[a-zA-Z0-9]{24,}", "[STRIPE_KEY_REDACTED]"),
    (r"rk_live_[a-zA-Z0-9]{24,}", "[STRIPE_RESTRICTED_KEY_REDACTED]"),
    (r"SG\.[a-zA-Z0-9_-]{22}\.[a-zA-Z0-9_-]{43}", "[SENDGRID_KEY_REDACTED]"),
    (r"SK[a-f0-9]{32}", "[TWILIO_KEY_REDACTED]"),
    (r"(?i)(secret|token|key|credential|auth)[^\n]*[\"']([a-f0-9]{32,64})[\"']", "$1=[REDACTED]"),
]


def redact_secrets(text: Column) -> Column:
    for pattern, into in REDACTIONS:
        text = F.regexp_replace(text, pattern, into)
    return text


def url_encode_path(path: Column) -> Column:
    for a, b in (("%", "%25"), (" ", "%20"), ("#", "%23"), ("?", "%3F"), ("&", "%26")):
        path = F.replace(path, F.lit(a), F.lit(b))
    return path


def escape_literal(text: Column) -> Column:
    """A string as N-Quads and SPARQL write it."""
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def relevance(line: Column, query: str) -> Column:
    """1, and 2 for the exact spelling, 3 for each word equal to the query, 1.5 for a definition, and up to 1 for a short line."""
    low = query.lower()
    words = F.size(F.filter(F.split(F.lower(line), r"\s+"), lambda w: w == low))
    return F.lit(1.0) + F.when(F.contains(line, F.lit(query)), 2.0).otherwise(0.0) + 3.0 * words + F.when(line.rlike(r"fn |def |func |class |struct "), 1.5).otherwise(0.0) + F.least(F.lit(100.0) / F.greatest(F.octet_length(line), F.lit(1)), F.lit(1.0))
