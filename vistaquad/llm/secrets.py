"""Secret scans with a random forest against false positives, in DataFrame operations only.

Candidates are runs of token characters that hold a digit, signed tokens, passwords in URLs, and values assigned to names
that tell of secrets or given to options of such names. A forest
on their length, character transitions, dictionary coverage, path and neighbouring words, learned from labelled
findings, says which are secrets.
"""

import base64
import re
from functools import lru_cache
from itertools import islice

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MIN_LENGTH = 16
CONTEXT = 48  # characters before and after a candidate that features look at

# Names of secrets, words that say what else a value is, words of placeholders, formats.
NAMES = ["password", "passwd", "passphrase", "pass", "pwd", "secret", "token", "api[_-]?key", "access[_-]?key", "private[_-]?key", "signing[_-]?key", "encryption[_-]?key", "secret[_-]?key", "stripe[_-]?key", "auth", "bearer", "credential", "webhook"]
OTHERS = ["commit", "sha1", "sha256", "md5", "checksum", "digest", "hash", "revision", "uuid", "guid", "etag", "order", "invoice", "card", "phone", "tracking", "version", "build"]
PLACEHOLDERS = ["example", "changeme", "your", "xxxx", "dummy", "sample", "test", "placeholder", "todo", "none", "null", "0000", "1234"]
FORMATS = ["AKIA[0-9A-Z]{16}", "gh[pousr]_[0-9A-Za-z]{36}", "xox[abpr]-[0-9A-Za-z-]{10,}", "sk_live_[0-9A-Za-z]{16,}", "AIza[0-9A-Za-z_-]{35}", "eyJ[0-9A-Za-z_-]{10,}"]

DICTIONARY = 2000  # words

# Signed tokens of three parts, as one candidate.
_SIGNED = r"\beyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"
_RUN = rf"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{{{MIN_LENGTH},}}+={{0,2}}+"
# The password of a URL's user.
_URL = r"(?<=://[^\s:/@]{1,64}:)[^\s:/@]{4,}+(?=@)"
# A name in code, JSON or YAML may be quoted; a bearer's value and that of a command's option follow after spaces, too.
_NAMED = r"(?i:" + "|".join(NAMES) + r")"
_SEPARATOR = r"[\x22']?\s{0,3}(?::=|[=:])"
_OPTION = rf"(?i:\bbearer|\bsshpass -p|--(?:[a-z0-9]{{1,16}}-)?{_NAMED})"
_ASSIGNED = rf"{_NAMED}{_SEPARATOR}|{_OPTION}\s|://[^\s:/@]{{1,64}}:[^\s:/@]{{4,}}+@"
_VALUE = rf"(?<=[=:\s\x22'])(?:(?<={_NAMED}{_SEPARATOR}\s{{0,3}}[\x22']?)|(?<={_OPTION}\s{{1,3}}[\x22']?))[^\s\x22',;=:]{{6,}}+"
_CANDIDATE = f"{_SIGNED}|{_URL}|{_RUN}|{_VALUE}"
_SPARK_ALL = f"({_CANDIDATE})"

FEATURES = ["length", "digits", "upper", "lower", "hexadecimal", "other", "distinct", "transitions", "switches", "vowels", "coverage", "entropy", "placeholder", "format", "named", "assigned", "quoted", "another", "uuid", "path_test", "path_config"]


def candidates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", path_column: str | None = None) -> DataFrame:
    """Each candidate of each text: id, start (characters from 0), candidate, before, after, path."""
    path = F.coalesce(F.col(path_column).cast("string"), F.lit("")) if path_column else F.lit("")
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"), path.alias("path")).where(F.col("text").rlike(_RUN) | F.col("text").rlike(_ASSIGNED) | F.col("text").rlike(_SIGNED))
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "id", "path", F.expr(f"regexp_extract_all(text, {_quoted(_SPARK_ALL)}, 1)").alias("found"), F.split("text", _CANDIDATE, -1).alias("between"))
    around = F.transform("found", lambda c, i: F.struct(i.alias("i"), c.alias("candidate"), F.get("between", i).alias("left"), F.substring(F.coalesce(F.get("between", i + 1), F.lit("")), 1, CONTEXT).alias("after")))
    each = rows.select("row", "id", "path", F.explode(around).alias("c")).select("row", "id", "path", "c.i", "c.candidate", "c.after", F.expr(f"right(c.left, {CONTEXT})").alias("before"), F.length("c.left").cast("long").alias("gap"))
    passed = Window.partitionBy("row").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    start = F.sum(F.col("gap") + F.length("candidate")).over(passed) - F.length("candidate")
    return each.select("id", start.alias("start"), "candidate", "before", "after", "path")


def _quoted(pattern: str) -> str:
    return "r'" + pattern.replace("'", "\\x27") + "'"


@lru_cache
def dictionary(path: str | None = None, size: int = DICTIONARY) -> tuple:
    """The first `size` words of four letters and more of a public vocabulary (a rank file; the English one unless given),
    which lists frequent words first."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as lines:
        tokens = (base64.b64decode(line.split()[0]) for line in lines)
        words = (t[1:].decode() for t in tokens if re.fullmatch(rb" [a-z]{4,}", t))
        return tuple(islice(words, size))


def pattern_of(words) -> str:
    """A pattern that matches the longest of words, with their common beginnings written once."""
    tree: dict = {}
    for word in words:
        node = tree
        for c in word:
            node = node.setdefault(c, {})
        node[""] = {}

    def shown(node: dict) -> str:
        parts = [c + shown(below) for c, below in sorted(node.items()) if c]
        if not parts:
            return ""
        text = parts[0] if len(parts) == 1 and "" not in node else f"(?:{'|'.join(parts)})"
        return f"{text}?" if "" in node else text

    return shown(tree)


def featured(found: DataFrame, words: tuple | None = None) -> DataFrame:
    """The columns FEATURES of candidate, before, after and path; words: the dictionary."""
    c, low = F.col("candidate"), F.lower("candidate")
    size = F.greatest(F.length(c), F.lit(1)).cast("double")
    share = lambda kind: F.length(F.regexp_replace(c, f"[^{kind}]", "")) / size
    any_of = lambda words: "(?i)(?:" + "|".join(words) + ")"
    flag = lambda x: F.coalesce(x, F.lit(False)).cast("double")
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[A-Z]", "U"), "[a-z]", "l"), "[0-9]", "d"), "[^Uld]", "o")
    runs = F.length(F.regexp_replace(classes, r"(.)\1*+", "x"))
    letters = F.array_distinct(F.split(c, ""))
    counts = F.transform(letters, lambda x: (F.length(c) - F.length(F.replace(c, x, F.lit("")))) / size)
    entropy = F.aggregate(counts, F.lit(0.0), lambda a, p: F.when(p > 0, a - p * F.log2(p)).otherwise(a))
    return found.withColumns(
        {
            "length": F.log1p(F.length(c).cast("double")),
            "digits": share("0-9"),
            "upper": share("A-Z"),
            "lower": share("a-z"),
            "hexadecimal": share("0-9a-fA-F"),
            "other": F.length(F.regexp_replace(c, "[A-Za-z0-9]", "")) / size,
            "distinct": F.size(letters) / size,
            "transitions": runs / size,
            "switches": F.length(F.regexp_replace(c, "[a-zA-Z][0-9]", "")) / size,
            "vowels": share("aeiouAEIOU"),
            "coverage": 1 - F.length(F.regexp_replace(low, pattern_of(words or dictionary()), "")) / size,
            "entropy": entropy,
            "placeholder": flag(low.rlike(any_of(PLACEHOLDERS)) | c.rlike(r"(.)\1{5}")),
            "format": flag(c.rlike("(?:" + "|".join(FORMATS) + ")")),
            "named": flag(F.col("before").rlike(any_of(NAMES) + r"[^A-Za-z0-9]{0,6}$")),
            "assigned": flag(F.col("before").rlike(r"[=:]\s{0,3}[\x22']?$")),
            "quoted": flag(F.col("before").rlike(r"[\x22']$") & F.col("after").rlike(r"^[\x22']")),
            "another": flag(F.col("before").rlike(any_of(OTHERS) + r"[^A-Za-z0-9]{0,6}$")),
            "uuid": flag(c.rlike("^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$")),
            "path_test": flag(F.col("path").rlike("(?i)(?:test|example|fixture|sample|docs?/)")),
            "path_config": flag(F.col("path").rlike(r"(?i)\.(?:env|pem|cfg|ini|ya?ml|conf|toml)$")),
        }
    )


# Fixed values of the findings. The names are found by NAMES; some stand-ins hold a word of PLACEHOLDERS, as real ones do.
_SECRET_NAMES = ["db_pass", "DB_PASSWORD", "aws_secret_access_key", "client_secret", "stripe_key", "smtp_password", "auth_token", "X-Api-Key", "signing_key", "webhook_secret", "refresh_token", "encryption_key", "sshpass", "slack_webhook", "jwt_secret", "SENDGRID_API_KEY"]
_PLAIN_NAMES = ["commit", "rev", "sha", "md5sum", "etag", "request_id", "trace", "isbn", "serial", "sku", "iban", "ticket", "session started", "build id", "image", "asset", "href", "see", "checksum of", "file", "font", "from page", "opened", "named", "device", "layout", "node", "at"]
_PARTS = ["Report", "invoice", "header", "thumb", "Http", "Servlet", "Factory", "quarter", "summary", "sprite", "vendor", "chunk", "polyfill", "userAgent", "kubernetes", "terraform", "madrid", "autumn", "grenoble", "wordpress", "tutorial", "lecture", "homework", "readme"]
_STAND_INS = ["<insert-key-here>", "REPLACE_ME_PLEASE", "my-secret-goes-here", "aaaaaaaaaaaaaaaa", "XXXXXXXXXXXXXXXX", "put_your_key_in_here", "foobarbaz", "not-a-real-token", "${SECRET_FROM_ENV}", "****************", "abcdefghijklmnop", "{{ vault_password }}", "process.env.API_KEY", "os.environ_lookup", "required_string", "undefined"]


def labelled_findings(spark: SparkSession, n: int = 8000) -> DataFrame:
    """Findings with labels, made by rule: candidate, before, after, path, label (1: a secret).

    No table labels secrets, so findings are drawn: secrets are random values of several alphabets and lengths, most of
    them beside a name that tells; the others are digests, identifiers, numbers, times, compound names and paths beside
    other words, and what stands in for a secret beside names that tell. tests/llm hold the forest against findings
    labelled by hand, which no rule here makes.
    """
    h = lambda salt, bits=256: F.sha2(F.concat_ws("/", F.lit(salt), F.col("i")), bits)
    draw = lambda salt, n: F.pmod(F.xxhash64(F.lit(salt), F.col("i")), F.lit(n)).cast("int")
    pick = lambda salt, values: F.get(F.array(*(v if isinstance(v, Column) else F.lit(v) for v in values)), draw(salt, len(values)))
    b64 = lambda salt: F.regexp_replace(F.base64(F.unhex(h(salt))), r"\s", "")
    letters = lambda salt: F.regexp_replace(F.concat(b64(salt), b64(salt + "'")), "[^A-Za-z0-9]", "")
    cut = lambda x, salt, least, most: x.substr(F.lit(1), draw(salt, most - least + 1) + least)
    digits = lambda salt: F.concat(F.abs(F.xxhash64(F.lit(salt), F.col("i"))).cast("string"), F.abs(F.xxhash64(F.lit(salt + "'"), F.col("i"))).cast("string"))
    uuid = F.regexp_replace(F.substring(h("u"), 1, 32), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    part = lambda salt: pick(salt, _PARTS)
    compound = F.concat(part("a1"), pick("a2", ["", "-", "_", "/", "2", "3"]), part("a3"), pick("a4", ["", "-", "_", "/"]), part("a5"), pick("a6", ["1", "2024", "_v2", "-07", "2x", "_001", ""]))
    time = F.concat_ws("-", (draw("t1", 60) + 1970).cast("string"), F.lpad((draw("t2", 12) + 1).cast("string"), 2, "0"), F.concat(F.lpad((draw("t3", 28) + 1).cast("string"), 2, "0"), F.lit("T"), F.lpad(draw("t4", 24).cast("string"), 2, "0")))
    secret_value = pick("sv", [F.substring(h("a"), 1, 40), F.substring(h("b"), 1, 32), h("g"), b64("c"), cut(letters("d"), "d1", 20, 44), cut(letters("e"), "e1", 10, 18), F.concat(pick("f1", ["ghp_", "gho_"]), F.substring(F.concat(letters("f"), letters("ff")), 1, 36)), F.concat(F.lit("AKIA"), F.upper(F.substring(h("k"), 1, 16))), F.concat(pick("m1", ["sk_live_", "rk-", "key-", "xoxb-"]), cut(letters("m"), "m2", 18, 30)), F.concat(part("n1"), pick("n2", ["!", "#", "_", "$"]), cut(letters("n"), "n3", 4, 9))])
    other_value = pick("ov", [F.substring(h("l"), 1, 40), h("p"), F.substring(h("o"), 1, 32), uuid, cut(digits("q"), "q1", 16, 22), compound, compound, compound, time, F.concat(F.lit("/"), compound, F.lit("."), pick("r1", ["png", "js", "css", "html"]))])
    kind = F.pmod(F.col("i"), F.lit(8))
    secret, stand_in = kind < 4, kind == 4
    quote = pick("quote", ['"', "'", "", '"'])
    names = F.concat(pick("v", ["the ", "export ", "  ", "", "const "]), pick("s", _SECRET_NAMES), pick("t", [" = ", ": ", "=", " := "]), quote)
    plain = F.concat(pick("y", ["", "of the ", "in ", "and "]), pick("z", _PLAIN_NAMES), pick("w", [" ", ": ", " = ", " (", "="]), pick("w2", ["", "", quote]))
    bare = secret & (kind == 3) & (draw("bare", 2) == 0)
    rows = spark.range(n).withColumnRenamed("id", "i")
    return rows.select(
        F.when(secret, secret_value).when(stand_in, F.concat(pick("x", _STAND_INS), pick("x1", ["", "", "1", "42"]))).otherwise(other_value).alias("candidate"),
        F.when(bare, pick("b", ["the key is ", "use ", "login with ", ""])).when(secret | stand_in, names).otherwise(plain).alias("before"),
        F.when(bare, F.lit(" ")).when(secret | stand_in, F.concat(quote, F.lit(" "))).otherwise(pick("n", [" ", ")", ".", ", "])).alias("after"),
        pick("path", ["", "", "src/app.py", "config/app.env", "deploy/values.yaml", "tests/test_app.py"]).alias("path"),
        secret.cast("double").alias("label"),
    )


def fit_secrets(findings: DataFrame, trees: int = 40, depth: int = 8, seed: int = 5) -> PipelineModel:
    """A forest on labelled findings (candidate, before, after, path, label); they fit one partition, so results repeat."""
    forest = RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=trees, maxDepth=depth, seed=seed)
    return Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="features"), forest]).fit(featured(findings).coalesce(1))


def secrets(docs: DataFrame, model: PipelineModel, id_column: str = "doc_id", text_column: str = "text", path_column: str | None = None) -> DataFrame:
    """Each candidate of each text: id, start and length in characters, candidate, score (0 to 1: a secret).

    Null and empty texts have no candidates. Null ids are passed on, repeated rows repeat their candidates, an empty
    table gives none. A null path counts as empty. Other columns are not looked at.
    """
    scored = model.transform(featured(candidates(docs, id_column, text_column, path_column)))
    return scored.select("id", "start", F.length("candidate").cast("long").alias("size"), "candidate", vector_to_array("probability")[1].alias("score"))


def secret_query(docs: DataFrame) -> DataFrame:
    """op10: every candidate with its score; the value itself only as a digest. documents have no paths, so source stands for them."""
    model = fit_secrets(labelled_findings(docs.sparkSession))
    found = secrets(docs, model, path_column="source")
    return found.select(F.col("id").alias("doc_id"), "start", "size", F.sha2("candidate", 256).alias("candidate_sha256"), "score", (F.col("score") >= 0.5).alias("secret"))
