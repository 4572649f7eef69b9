"""Secret scans: candidates judged by a random forest.

Candidates are runs of 12 or more letters, digits and ``+/_-`` that hold a digit
and a letter, and, of any length and characters, what stands after a credential
word and an assignment up to a blank or the closing quote. Features are the candidate's length, character transitions,
distinct characters, dictionary coverage, whether it lies in a path, whether it
is a placeholder or a word of prose, and the words before it. The forest is trained on labelled findings, which
``labelled_findings`` makes by rule: keys in the forms that services hand out,
and look-alikes such as commit ids, UUIDs, paths, versions and identifiers. Its
trees are read into one SQL expression, so that scanning is a projection: no
shuffle, no Python.

Every occurrence of a candidate is a finding of its own, judged where it stands.
``redact`` masks a value throughout its text if any of its occurrences is secret.

Defined cases: null and empty texts have no findings and stay as they are;
repeated rows each have theirs; an empty table gives no rows; extra columns are
ignored by the scan and kept by ``redact``; null doc_id is kept.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import pick

#: Tried at the beginning of a run only; looks ahead never go back, so that the time follows the length of the text.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{12,}={0,2}"
_RUN = r"^[A-Za-z0-9+/_-]{12,}={0,2}$"
_NAMED = r"(?i:passw[a-z]{0,4}|pwd|secret|token|api[_ -]?key|access[_ -]?key|private[_ -]?key|credentials?|auth|bearer|contraseña|kennwort|mot de passe)"
#: What is assigned to a credential word: cheap looks behind first, then the whole of it.
ASSIGNED = (
    r"""(?<=[=:>\s"'`])(?=\S)(?<=[=:>]\s{0,3}["'`]?|[Rr]\s{1,3}["'`]?)(?!(?<=[:=])[=>])(?!(?<=[=:>]\s{0,3})["'`])"""
    rf"""(?<={_NAMED}(?:s|[_0-9A-Z-][A-Za-z0-9_-]{{0,11}})?["'`]?\s{{0,3}}(?::=|=>|={{1,3}}|:)\s{{0,3}}["'`]?|(?i:bearer)\s{{1,3}}["'`]?)"""
    r"""(?:(?<=")[^"\s]+(?=")|(?<=')[^'\s]+(?=')|(?<=`)[^`\s]+(?=`)|[$%]?[<\[{]{1,2}[^\s<>\[\]{}]*[>\]}]{1,2}|\S*[^\s"'`,;.)\]}>]|[^\s"'`]\S*)"""
)
#: Every text with a candidate has one of these.
ANY = r"[0-9=:]|(?i:bearer)"
#: Values that are no secrets wherever they stand: placeholders, calls, names of things.
PLAIN = (
    r"(?i)^(null|none|nil|true|false|yes|no|on|off|undefined|required|optional|string|str|int|integer|bool|boolean|text|type|default|example|your.*|the|a|an|it|is|are|was|and|or|for|of|to|in|we|you|this|that|bearer|basic|"
    r"sha|commit|https?:.*)$|^[<\[{(%*$][^ ]*[>\]})*]$|^\$[A-Z_]+$|^%[a-z]$|^[*•x.]+$|\(|^[a-z_]+(\.[a-z_]+)+"
)
#: Characters of the text before and after a candidate that count as its neighbours.
BEFORE, AFTER = 32, 12
#: Candidates that may stand among those neighbours on either side; each takes 4 characters or more.
NEAR = 8
#: Steps that are summed in one run.
BLOCK = 256
#: Fragments of words that names and identifiers are made of.
WORDS = (
    "user|name|test|example|http|www|html|image|photo|data|file|page|index|version|release|build|time|date|type|list|item|code|text|"
    "page|view|edit|node|line|word|size|color|style|class|table|model|system|server|client|local|public|config|default|update|report|"
    "order|number|part|chapter|section|figure|report|draft|final|copy|new|old|the|and|tion|ing|ment"
)
FEATURES = ("length", "turns", "distinct", "digits", "uppers", "hexes", "covered", "path", "called", "assigned", "other", "known", "dashes", "plain", "tight")
MASK = "[SECRET]"


def features(value: Column, before: Column, after: Column) -> list[Column]:
    """The forest's inputs, in the order of FEATURES."""
    n = F.length(value).cast("double")
    share = lambda pattern: (n - F.length(F.regexp_replace(value, pattern, ""))) / n
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    low = F.lower(before)
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[0-9]+", "0"), "[a-z]+", "a"), "[A-Z]+", "A")
    return [
        n,
        F.length(shape) / n,
        F.size(F.array_distinct(F.split(value, ""))) / n,
        share("[0-9]"),
        share("[A-Z]"),
        share("[0-9a-f]"),
        share(f"(?i)({WORDS})"),
        flag(F.rlike(before, F.lit(r"[/.]$")) | F.rlike(value, F.lit(r"[a-z]/[a-z]|^/")) | F.rlike(after, F.lit(r"^\.[a-z]{2,4}"))),
        flag(F.rlike(low, F.lit(r"(passw|passwd|pwd|secret|token|api[_ -]?key|access[_ -]?key|private|credential|auth|bearer|contraseña|kennwort|mot de passe)"))),
        flag(F.rlike(before, F.lit(r"([=:]|[Bb]earer|:=|=>)\s*[\"'`]?$"))),
        flag(F.rlike(low, F.lit(r"(commit|sha|hash|digest|uuid|guid|etag|md5|checksum|revision|version|isbn|order|invoice|doi|build)[^.]{0,12}$"))),
        flag(F.rlike(value, F.lit(r"^(AKIA|ASIA)[A-Z0-9]{16}$|^gh[pousr]_[A-Za-z0-9]{30,}|^sk[-_][A-Za-z0-9_-]{16,}|^xox[abprs]-|^AIza[A-Za-z0-9_-]{30,}|^glpat-|^eyJ[A-Za-z0-9_-]{10,}"))),
        share("[-_]"),
        flag(F.rlike(value, F.lit(PLAIN))),
        flag(F.rlike(before, F.lit(r"=\s?[\"'`]?$|[\"'`]$"))),
    ]


def labelled_findings(spark: SparkSession, rows: int = 6_000) -> DataFrame:
    """(value, before, after, secret, row, form): labelled findings in ``rows`` rows, by rule from their numbers; a form is one of the rules."""
    i = F.col("id")
    hexes = lambda salt: F.sha2(F.concat(F.lit(salt), i.cast("string")).cast("binary"), 256)
    mixed = lambda salt: F.translate(F.base64(F.unhex(hexes(salt))), "+/=", "xYz")
    upper = lambda salt: F.upper(F.translate(mixed(salt), "lo", "23"))
    word = lambda salt: F.element_at(F.split(F.lit("amber brook cedar delta ember flint grove haven inlet jetty knoll larch maple north ocean prism"), " "), F.pmod(F.xxhash64(F.lit(salt), i), F.lit(16)).cast("int") + 1)
    size = lambda low, span: (F.lit(low) + F.pmod(F.xxhash64(F.lit("n"), i), F.lit(span))).cast("int")
    cut = lambda text, low, span: F.substring(text, F.lit(1), size(low, span))
    prose = F.concat_ws(" ", word("p"), word("q"), word("r"))
    one = lambda salt, text: F.element_at(F.split(F.lit(text), " "), F.pmod(F.xxhash64(F.lit(salt), i), F.lit(len(text.split(" ")))).cast("int") + 1)
    letters = lambda salt: F.translate(hexes(salt), "0123456789", "ghkmnpqrst")
    figures = lambda salt: F.translate(hexes(salt), "abcdef", "135790")
    named = lambda salt: one(salt, "password pwd secret token api_key auth_token client_secret Password TOKEN credential")
    tied = F.concat(prose, F.lit(" "), named("v"), one("w", "= =' =\" =` :\" :'"))
    loose = F.concat(prose, F.lit(" "), named("v"), F.lit(": "))
    either = F.when(F.pmod(F.xxhash64(F.lit("x"), i), F.lit(2)) == 0, tied).otherwise(loose)
    marked = F.concat(cut(mixed("y"), 3, 6), one("z", "! @ # $ . %"), F.substring(hexes("y"), 1, 3))
    plain = one("A", "null None true false required optional string undefined the your_password ${DB_PASSWORD} $TOKEN <password> **** {{token}} %s [SECRET] getToken() os.environ config.secret_key (optional)")
    cases = [
        (1, F.concat(F.lit("AKIA"), F.substring(upper("a"), 1, 16)), F.concat(prose, F.lit(" ")), F.lit(" ")),
        (1, F.substring(hexes("b"), 1, 40), F.concat(prose, F.lit(' token = "')), F.lit('" ')),
        (1, cut(hexes("c"), 14, 12), F.concat(prose, F.lit(" password=")), F.lit(" ")),
        (1, cut(mixed("d"), 16, 24), F.concat(prose, F.lit(" api_key: ")), F.lit("\n")),
        (1, F.concat(F.lit("ghp_"), F.substring(mixed("e"), 1, 36)), F.concat(prose, F.lit(" ")), F.lit(" ")),
        (1, F.concat(F.lit("sk-"), cut(mixed("f"), 24, 18)), F.concat(prose, F.lit(" key ")), F.lit(",")),
        (1, cut(mixed("g"), 20, 20), F.concat(prose, F.lit(" secret='")), F.lit("'")),
        (1, cut(mixed("h"), 24, 16), F.concat(F.lit("Authorization: Bearer ")), F.lit(" ")),
        (0, F.substring(hexes("i"), 1, 40), F.concat(prose, F.lit(" commit ")), F.lit(" ")),
        (0, F.substring(hexes("j"), 1, 32), F.concat(F.lit("md5 checksum: ")), F.lit(" ")),
        (0, F.concat_ws("-", F.substring(hexes("k"), 1, 8), F.substring(hexes("k"), 9, 4), F.substring(hexes("k"), 13, 4), F.substring(hexes("k"), 17, 4), F.substring(hexes("k"), 21, 12)), F.concat(prose, F.lit(" ")), F.lit(" ")),
        (0, F.concat(F.lit("images/"), word("l"), F.lit("/photo"), i.cast("string")), F.concat(F.lit("www.example.com/")), F.lit(".html ")),
        (0, F.concat(word("m"), F.lit("_version_"), i.cast("string")), F.concat(prose, F.lit(" ")), F.lit(" ")),
        (0, F.concat(word("n"), word("o"), F.lit("Report"), i.cast("string")), F.concat(prose, F.lit(" ")), F.lit(", ")),
        (0, F.concat(F.lit("2024-"), F.pmod(i, F.lit(12)).cast("string"), F.lit("-release-"), i.cast("string")), F.concat(prose, F.lit(" ")), F.lit(" ")),
        (0, F.concat(word("s"), F.lit("-"), word("t"), F.lit("-chapter-"), i.cast("string")), F.concat(F.lit("/docs/")), F.lit(".html")),
        (0, F.substring(hexes("u"), 1, 24), F.concat(prose, F.lit(" order id ")), F.lit(" ")),
        (1, F.concat(F.initcap(word("B")), F.substring(figures("B"), 1, 2)), either, F.lit(" ")),
        (1, F.concat(word("C"), F.substring(figures("C"), 1, 1), F.substring(letters("C"), 1, 1)), either, F.lit("\n")),
        (1, marked, either, F.lit(" ")),
        (1, cut(letters("D"), 5, 24), tied, F.lit("' ")),
        (1, cut(letters("E"), 18, 14), loose, F.lit("\n")),
        (1, cut(figures("F"), 4, 16), either, F.lit(" ")),
        (1, F.concat(word("G"), word("H")), tied, F.lit(" ")),
        (1, F.concat(F.initcap(word("G"))), tied, F.lit(" ")),
        (0, word("I"), loose, F.lit(" ")),
        (0, one("J", "expired missing invalid limits access rotation was sharing forgotten incorrect authentication"), loose, F.concat(F.lit(" "), word("K"))),
        (0, plain, either, F.lit(" ")),
        (0, plain, either, F.lit('" ')),
    ]
    choose = F.pmod(i, F.lit(len(cases)))
    made = [F.struct(value.alias("value"), before.alias("before"), after.alias("after"), F.lit(float(secret)).alias("secret")) for secret, value, before, after in cases]
    chosen = reduce(lambda rest, c: F.when(choose == c[0], c[1]).otherwise(rest), list(enumerate(made))[:-1], made[-1])
    # Spark interprets what a transform holds; as code the rules pass the limit of a method, and each try to compile them fills the driver's memory.
    found = F.transform(F.array(i), lambda _: chosen)
    return spark.range(rows, numPartitions=2).select(F.inline(found), i.alias("row"), choose.alias("form"))


def train(spark: SparkSession, findings: DataFrame | None = None, trees: int = 20, depth: int = 6) -> list[list[tuple]]:
    """The forest as plain trees: (feature, cut, left, right) or a share of secrets."""
    findings = labelled_findings(spark) if findings is None else findings
    x = findings.select(*[c.alias(n) for n, c in zip(FEATURES, features(F.col("value"), F.col("before"), F.col("after")), strict=True)], "secret")
    x = x.persist()  # fitting reads it many times
    data = VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(x)
    try:
        model = RandomForestClassifier(featuresCol="x", labelCol="secret", numTrees=trees, maxDepth=depth, seed=7).fit(data)
    finally:
        x.unpersist()

    def read(node):
        if node.subtreeDepth() == 0:
            counts = list(node.impurityStats().stats())
            return counts[1] / max(sum(counts), 1e-9)
        return (node.split().featureIndex(), node.split().threshold(), read(node.leftChild()), read(node.rightChild()))

    return [read(t._call_java("rootNode")) for t in model.trees]


def score(forest: list, x: list[Column]) -> Column:
    """Mean over the trees of the share of secrets in the leaf."""

    def walk(node) -> Column:
        if isinstance(node, float):
            return F.lit(node)
        at, cut, left, right = node
        return F.when(x[at] <= cut, walk(left)).otherwise(walk(right))

    return reduce(lambda a, b: a + b, [walk(t) for t in forest]) / F.lit(float(len(forest)))


def starts(steps: Column) -> Column:
    """The sum of the steps before each one, in blocks so that the work grows with their number."""
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)
    running = lambda base, xs: F.aggregate(xs, F.array(base), lambda a, x: F.array_append(a, F.element_at(a, -1) + x))
    blocks = F.transform(F.sequence(F.lit(1), F.greatest(F.size(steps), F.lit(1)), F.lit(BLOCK)), lambda i: F.slice(steps, i, F.lit(BLOCK)))
    bases = running(F.lit(0), F.transform(blocks, total))
    return F.flatten(F.transform(blocks, lambda xs, i: F.slice(running(F.get(bases, i), xs), F.lit(1), F.size(xs))))


def findings(text: Column, forest: list) -> Column:
    """An array of (value, start, score) for a text's candidates, each where it stands; start counts characters from 0."""
    named = F.filter(_places(text, ASSIGNED), lambda f: ~F.rlike(f["value"], F.lit(_RUN)) | ~F.rlike(f["value"], F.lit(CANDIDATE)))
    found = F.concat(_places(text, CANDIDATE), named)  # a candidate of both kinds comes once

    def measure(p: Column) -> Column:
        return F.struct(p["value"].alias("value"), p["start"].alias("start"), F.array(*features(p["value"], p["before"], p["after"])).alias("x"))

    def judged(p: Column) -> Column:
        return F.struct(p["value"].alias("value"), p["start"].alias("start"), score(forest, [p["x"][i] for i in range(len(FEATURES))]).alias("score"))

    # Both kinds are measured and judged by one expression, so that the forest is in the plan once.
    return F.transform(F.transform(found, measure), judged)


def _places(text: Column, pattern: str) -> Column:
    """An array of (value, start, before, after) for the matches of a pattern."""
    # The text is gap, candidate, gap, ..., candidate, gap.
    walk = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))

    def placed(w: Column) -> Column:
        pieces = F.zip_with(F.slice(w["gaps"], F.lit(1), F.size(w["found"])), w["found"], lambda g, v: F.concat(g, v))
        return F.struct(w["gaps"].alias("gaps"), w["found"].alias("found"), pieces.alias("pieces"), starts(F.transform(pieces, F.length)).alias("starts"))

    def places(w: Column) -> Column:
        def place(value: Column, i: Column) -> Column:
            gap = F.get(w["gaps"], i)
            # Candidates and their gaps are short at times, so that neighbours reach over several.
            past = F.concat(F.array_join(F.slice(w["pieces"], F.greatest(i - NEAR, F.lit(0)) + 1, F.least(i, F.lit(NEAR))), ""), gap)
            ahead = F.concat(F.get(w["gaps"], i + 1), F.array_join(F.zip_with(F.slice(w["found"], i + 2, F.lit(NEAR)), F.slice(w["gaps"], i + 3, F.lit(NEAR)), lambda v, g: F.concat(v, F.coalesce(g, F.lit("")))), ""))
            return F.struct(
                value.alias("value"), (F.get(w["starts"], i) + F.length(gap)).alias("start"),
                F.right(past, F.lit(BEFORE)).alias("before"), F.left(ahead, F.lit(AFTER)).alias("after"),
            )

        return F.transform(w["found"], place)

    # A transform over one element names a value that is used often.
    return F.flatten(F.transform(F.transform(F.array(walk), placed), places))


def scan(docs: DataFrame, forest: list, threshold: float = 0.5) -> DataFrame:
    """Every finding: its place, digest, score and verdict."""
    rows = pick(docs, doc_id="long", text="string").where(F.rlike("text", F.lit(ANY)))
    rows = rows.select("doc_id", F.explode(findings(F.col("text"), forest)).alias("f"))
    return rows.select(
        "doc_id", F.col("f.start").cast("long").alias("start"), F.length("f.value").cast("long").alias("length"),
        F.sha2(F.col("f.value").cast("binary"), 256).alias("value_sha256"), F.col("f.score").alias("score"), (F.col("f.score") >= threshold).cast("int").alias("secret"),
    )


def redact(docs: DataFrame, forest: list, threshold: float = 0.5) -> DataFrame:
    """The documents with every secret replaced by MASK; all rows and columns stay.

    ``n_chars``, where there is one, follows the text.
    """
    secrets = F.filter(findings(F.col("text"), forest), lambda f: f["score"] >= threshold)
    values = F.array_distinct(F.transform(secrets, lambda f: f["value"]))
    values = F.array_sort(F.transform(values, lambda v: F.struct((-F.length(v)).alias("n"), v.alias("value"))))  # a longer one may hold a shorter
    quoted = lambda v: F.concat(F.lit(r"\Q"), F.replace(v, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    # Short values stand in other words, too: these stay.
    alone = lambda v: F.concat(F.lit(r"(?<![\p{L}\p{N}])"), quoted(v), F.lit(r"(?![\p{L}\p{N}])"))
    hide = lambda t, v: F.when(F.length(v) >= 12, F.replace(t, v, F.lit(MASK))).otherwise(F.regexp_replace(t, alone(v), F.lit(MASK)))
    hidden = F.aggregate(values, F.col("text"), lambda t, v: hide(t, v["value"]))
    out = docs.withColumn("text", F.when(F.rlike("text", F.lit(ANY)), hidden).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
