"""Secret scans: candidate tokens, and a random forest that removes false positives.

A candidate is a run of 16 or more of A-Z a-z 0-9 _ + / = - that holds a digit. The forest judges it by length,
alphabet shares, entropy, character transitions, coverage by dictionary fragments, the path it was found
under, and the words beside it; it is trained on a table of labelled findings (label, path, before, found,
after), by default the made-up one below. Scanning and judging are DataFrame functions and the JVM forest.

Edge rules: null and empty texts have no findings; every occurrence of a repeated secret is a finding, and so
are those of repeated rows; a null path is empty; very long texts and candidates are taken whole; an empty
table gives no rows; other columns are ignored, whatever their names. Offsets are in characters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

RUN = "A-Za-z0-9_+/=-"
#: Zero-width: where a candidate begins.
_BEGIN = rf"(?<![{RUN}])(?=[{RUN}]{{16}})(?=[A-Za-z_+/=-]*+[0-9])"
SECRET_WORDS = r"(?i)\b(api[_-]?key|key|token|secret|password|passwd|pwd|auth|authorization|bearer|credentials?|access)\b"
HARMLESS_WORDS = r"(?i)\b(commit|sha\d*|md5|digest|checksum|hash|etag|uuid|guid|revision|rev|version|release|order|invoice|isbn|doi|file|path|url|image|build)\b"
HARMLESS_PATH = r"(?i)(^|[/_.-])(tests?|examples?|samples?|docs?|fixtures?|mocks?|vendor|lock)([/_.-]|$)"
#: Frequent fragments of names and prose (fixed values of this scanner).
DICTIONARY = (
    "able", "access", "admin", "after", "and", "app", "archive", "area", "ation", "back", "base", "block", "book", "build", "case", "chapter", "check", "class", "client", "code", "com", "config", "core",
    "data", "date", "day", "default", "dev", "dir", "doc", "down", "end", "ent", "error", "ever", "example", "file", "final", "first", "for", "form", "from", "ful", "group", "guide", "head", "help", "home",
    "html", "image", "index", "info", "ing", "intro", "item", "lang", "lib", "line", "link", "list", "local", "log", "main", "man", "ment", "mode", "month", "name", "ness", "net", "new", "node", "note", "number",
    "old", "out", "over", "own", "package", "page", "part", "path", "photo", "place", "plan", "point", "post", "pre", "project", "python", "read", "release", "report", "road", "section", "server", "service",
    "set", "site", "size", "stand", "start", "state", "system", "table", "test", "text", "the", "time", "tion", "type", "under", "unit", "user", "usr", "value", "version", "view", "was", "week", "with", "word", "work", "year",
)
FEATURES = ("length", "digits", "upper", "lower", "signs", "hex", "entropy", "transitions", "coverage", "vowels", "secret_word", "harmless_word", "harmless_path", "assigned", "quoted")


def _share(found: Column, pattern: str) -> Column:
    return F.regexp_count(found, F.lit(pattern)) / F.length(found)


def features(found: Column, before: Column, after: Column, path: Column) -> dict[str, Column]:
    n = F.length(found).cast("double")
    chars = F.array_distinct(F.split(found, ""))
    entropy = F.aggregate(
        F.transform(F.filter(chars, lambda c: c != ""), lambda c: (n - F.length(F.replace(found, c, F.lit("")))) / n), F.lit(0.0), lambda s, p: s - p * F.log2(p)
    )
    flag = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    return {
        "length": F.least(n, F.lit(256.0)),
        "digits": _share(found, "[0-9]"),
        "upper": _share(found, "[A-Z]"),
        "lower": _share(found, "[a-z]"),
        "signs": _share(found, "[_+/=-]"),
        "hex": _share(found, "[0-9a-fA-F]"),
        "entropy": entropy,
        "transitions": F.regexp_count(found, F.lit("(?<=[a-z])(?![a-z])|(?<=[A-Z])(?![A-Z])|(?<=[0-9])(?![0-9])")) / n,
        "coverage": F.lit(1.0) - F.length(F.regexp_replace(F.lower(found), "|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w))), "")) / n,
        "vowels": _share(found, "[aeiouAEIOU]"),
        "secret_word": flag(F.regexp_like(before, F.lit(SECRET_WORDS))),
        "harmless_word": flag(F.regexp_like(before, F.lit(HARMLESS_WORDS))),
        "harmless_path": flag(F.regexp_like(path, F.lit(HARMLESS_PATH))),
        "assigned": flag(F.regexp_like(before, F.lit(r"[=:]\s*[\"'`]?$"))),
        "quoted": flag(F.regexp_like(before, F.lit(r"[\"'`]$")) & F.regexp_like(after, F.lit(r"^[\"'`]"))),
    }


def _starts(pieces: Column) -> Column:
    """Where each piece begins: running sums of lengths, over runs of 256 pieces and then within each."""
    long, none = F.lit(0).cast("bigint"), F.expr("cast(array() as array<bigint>)")

    def running(sizes: Column, first: Column) -> Column:
        start = F.struct(first.alias("total"), none.alias("at"))
        return F.aggregate(sizes, start, lambda s, n: F.struct((s["total"] + n).alias("total"), F.array_append(s["at"], s["total"]).alias("at")))["at"]

    sizes = F.transform(pieces, lambda p: F.length(p).cast("bigint"))
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / 256).cast("int")), lambda k: F.slice(sizes, k * 256 + 1, F.lit(256)))
    sums = lambda r: F.transform(r, lambda x: F.aggregate(x, long, lambda s, n: s + n))
    both = lambda r: F.arrays_zip(r.alias("sizes"), running(sums(r), long).alias("first"))
    return F.flatten(F.transform(let(runs, both), lambda r: running(r["sizes"], r["first"])))


def candidates(docs: DataFrame, path: str | None = "source") -> DataFrame:
    """(doc_id, path, start, found, before, after): every candidate of every whole text, with 48 characters on each side.

    A text is cut where candidates begin; a candidate takes its run, its neighbours' 48 characters and its
    place, and only these small rows are exploded.
    """
    where = F.coalesce(F.col(path).cast("string"), F.lit("")) if path and path in docs.columns else F.lit("")
    rows = docs.select(F.col("doc_id"), where.alias("path"), F.split(F.col("text").cast("string"), _BEGIN).alias("pieces"))
    rows = rows.where("pieces is not null").withColumn("starts", _starts(F.col("pieces")))

    def cut(piece: Column, i: Column) -> Column:
        found = F.regexp_extract(piece, rf"^[{RUN}]*+", 0)
        left = F.when(i > 0, F.right(F.get("pieces", i - 1), F.lit(48))).otherwise(F.lit(""))
        after = F.substring(piece, F.length(found) + 1, F.lit(48))
        return F.struct(F.get("starts", i).alias("start"), found.alias("found"), left.alias("before"), after.alias("after"))

    # a piece begins with a candidate, but the first may not
    begins = lambda p: F.regexp_like(p, F.lit(rf"^[{RUN}]{{16}}")) & F.regexp_like(p, F.lit(r"^[A-Za-z_+/=-]*+[0-9]"))
    made = F.filter(F.transform("pieces", lambda p, i: F.when((i > 0) | begins(p), cut(p, i))), lambda c: c.isNotNull())
    return rows.select("doc_id", "path", F.explode(made).alias("c")).select("doc_id", "path", "c.*")


def let(value: Column, use) -> Column:
    """use(value) with value computed once a row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def labelled_findings(spark: SparkSession, n: int = 240, seed: int = 1) -> DataFrame:
    """Made-up labelled findings: n of each of six secret and nine harmless kinds."""
    h = F.sha2(F.concat_ws(":", F.lit(seed), F.col("kind"), F.col("id")), 256)
    b64 = F.translate(F.base64(F.unhex(h)), "=", "")
    rows = spark.range(n).crossJoin(spark.createDataFrame([(k,) for k in range(15)], "kind int"))  # n times fifteen made-up rows
    pick = lambda *words: F.element_at(F.array(*[F.lit(w) for w in words]), (F.pmod(F.xxhash64("id", "kind", F.lit(seed)), F.lit(len(words))) + 1).cast("int"))
    rows = rows.withColumn("h", h).withColumn("b", b64)
    size = (F.pmod(F.xxhash64("h"), F.lit(24)) + 20).cast("int")
    found = (
        F.when(F.col("kind") == 0, F.substring("h", 1, 40))
        .when(F.col("kind") == 1, F.substring(F.col("b"), F.lit(1), size))
        .when(F.col("kind") == 2, F.concat(F.lit("AK"), F.upper(F.translate(F.substring(F.col("b"), F.lit(1), F.lit(18)), "+/", "Z7"))))
        .when(F.col("kind") == 3, F.concat(pick("sk_live_", "ghp_", "xoxb-", "pk-"), F.translate(F.substring(F.col("b"), F.lit(1), F.lit(32)), "+/", "a9")))
        .when(F.col("kind") == 4, F.col("h"))
        .when(F.col("kind") == 5, F.substring("h", 1, 32))
        .when(F.col("kind") == 6, F.substring("h", 1, 40))
        .when(F.col("kind") == 7, F.substring("h", 1, 32))
        .when(F.col("kind") == 8, F.concat_ws("-", F.substring("h", 1, 8), F.substring("h", 9, 4), F.substring("h", 13, 4), F.substring("h", 17, 4), F.substring("h", 21, 12)))
        .when(F.col("kind") == 9, F.concat(pick("introduction-to-chapter-", "release_notes_section", "annual-report-project-", "photo_archive_week"), F.pmod(F.xxhash64("h"), F.lit(3000))))
        .when(F.col("kind") == 10, F.concat(F.lit("usr/lib/python3/"), pick("site-packages/config", "data/index/main", "server/admin/view"), F.pmod(F.xxhash64("h"), F.lit(90))))
        .when(F.col("kind") == 11, F.expr("lpad(cast(abs(xxhash64(h)) as string), 17, '4')"))
        .when(F.col("kind") == 12, F.concat(F.repeat(pick("x", "0", "ab", "-=", "_"), 12), F.pmod(F.xxhash64("h"), F.lit(100)), F.lit("0000")))
        .when(F.col("kind") == 13, F.concat(F.substring("h", 1, 36), F.lit("EXAMPLE0")))
        .otherwise(F.concat(F.lit("version-"), F.pmod(F.xxhash64("h"), F.lit(40)), F.lit("-2024-01-17-final")))
    )
    secret_before = pick('token = "', "api_key: ", "password='", 'secret = "', "Authorization: Bearer ", 'access key = "', "the auth token = ")
    before = (
        F.when(F.col("kind") <= 5, secret_before)
        .when(F.col("kind") == 6, pick("commit ", "revision ", "see commit ", "sha1 "))
        .when(F.col("kind") == 7, pick("md5 checksum ", "digest: ", 'etag "', "hash = "))
        .when(F.col("kind") == 8, pick("uuid ", "order ", "guid: ", "request "))
        .when(F.col("kind") == 13, pick('token = "', "key: "))
        .otherwise(pick("see the ", "in file ", "number ", "and then ", ""))
    )
    after = F.when(F.regexp_like("before", F.lit("\"$")), F.lit('"')).when(F.regexp_like("before", F.lit("'$")), F.lit("'")).otherwise(F.lit(" and"))
    path = F.when(F.col("kind") == 13, pick("docs/example.md", "tests/fixtures/a.json")).otherwise(pick("src/app.py", "src3", "config/prod.yml", "web"))
    return rows.select(found.alias("found"), before.alias("before"), path.alias("path"), (F.col("kind") <= 5).cast("double").alias("label")).withColumn("after", after)


def train(findings: DataFrame, trees: int = 24, depth: int = 7):
    """A random forest on findings(label, path, before, found, after)."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    x = findings.select("label", *[c.alias(n) for n, c in features(F.col("found"), F.col("before"), F.col("after"), F.col("path")).items()]).coalesce(1)
    x = VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(x)
    return RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=trees, maxDepth=depth, seed=7, subsamplingRate=0.8).fit(x)


def judge(found: DataFrame, model) -> DataFrame:
    """found with score (0 to 1) and secret; the columns of candidates() stay."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    cols = found.columns
    x = found.select("*", *[c.alias(f"_{n}") for n, c in features(F.col("found"), F.col("before"), F.col("after"), F.col("path")).items()])
    x = VectorAssembler(inputCols=[f"_{n}" for n in FEATURES], outputCol="x").transform(x)
    x = model.transform(x).withColumn("score", vector_to_array("probability")[1])
    return x.select(*cols, "score", (F.col("score") >= 0.5).alias("secret"))


def scan(docs: DataFrame, model=None, path: str | None = "source") -> DataFrame:
    """Every candidate of docs with its score; those with secret are the findings, the rest false positives."""
    return judge(candidates(docs, path), model or train(labelled_findings(docs.sparkSession)))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "start", F.length("found").cast("bigint").alias("length"), F.sha2("found", 256).alias("found_sha256"), F.round("score", 6).alias("score"), "secret")
