"""Secret scans: candidates by pattern, false positives removed by a random forest, all in DataFrame expressions.

A pattern finds candidates; their length, character transitions, dictionary coverage, path and neighbouring words are features; a forest trained from
labelled findings decides. Transitions and dictionary are counted over the whole corpus, whose distinct texts are shuffled once for that, and over the labelled false alarms.
The fitted trees become one column expression, so scoring and redaction are row by row inside the JVM: no shuffle, no Python on executors, and a text's candidates never leave its row.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What candidates look like, and words that speak for or against them.
_VALUE = "[A-Za-z0-9+/_=-]"
_KEYS = "password|passwd|pwd|secret|token|api_?key|access_?key"
_ASSIGNED = rf"(?i:{_KEYS})[\"']?\s{{0,2}}[=:]\s{{0,2}}[\"']?"
# A key block runs through its END line, however long it is; without one, through header lines, the blank line after them, and the lines that hold nothing but base64. Repeats are
# possessive: Java matches those in a loop, without a stack that grows with the block.
_NEW_LINE = r"[ \t]*+(?:\r?\n|\\n)[ \t]*+"
_LINE_ENDS = r"(?=[ \t]*+(?:\r|\n|\\n|\z))"
_PEM = (
    r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY(?: BLOCK)?-----(?:[^-]*+(?:-{1,4}[^-]++)*+-----END [A-Z ]{0,30}PRIVATE KEY(?: BLOCK)?-----"
    rf"|(?:{_NEW_LINE}[A-Za-z][A-Za-z0-9-]*+:[ \t][^\r\n\\]*+)*+(?:(?:{_NEW_LINE}(?=[\r\n\\]))?(?:{_NEW_LINE}[A-Za-z0-9+/=]++{_LINE_ENDS})++)?+)"
)
_URL = "://[^\\s/:@\"'<>]*+:"
_ISSUED = "(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk-[A-Za-z0-9]{20,}|eyJ[A-Za-z0-9_-]{6,}\\.[A-Za-z0-9_-]{6,}\\.[A-Za-z0-9_-]{6,})(?![A-Za-z0-9])"
# Assigned values run to the closing quote of their line, or else to white space; what ends a clause isn't theirs.
_QUOTED = "|".join(rf"(?<={q})(?=[^{q}\n]{{6}})[^{q}\\\n]*+(?:\\.[^{q}\\\n]*+){{0,100}}+(?={q})" for q in "\"'")
_BARE = r"[^\s\"'<>]{5,}[^\s\"'<>,;.:)\]}]"
_KEY = rf"(?:{_ASSIGNED}|{_URL})"
CANDIDATE = rf"{_ASSIGNED}(?:{_PEM}|{_QUOTED}|{_BARE})|{_URL}[^\s/\"'<>]{{3,}}(?=@)|{_ISSUED}|{_PEM}|(?<![A-Za-z0-9+/_=-])(?=[A-Za-z0-9+/_-]*[0-9]){_VALUE}{{16,}}"
_WORDS = "the|and|for|this|that|with|from|your|here|test|example|sample|dummy|placeholder|change|default|user|name|file|main|java|module|class|section|chapter|version|release|data|value|index|page|image|report|table|model|config|build|order|item|local|host|admin|null|none|true|false|abc|xxx|key|token|secret|password"
_PAIRS = "th|he|in|er|an|re|on|at|en|nd|ti|es|or|te|of|ed|is|it|al|ar|st|nt|ng|se|ha|as|ou|io|le|ve|co|me|de|hi|ri|ro|ic|ne|ea|ra|ce|li|ch|ll|be|ma|si|om|ur"
_AGAINST = "example|sample|dummy|placeholder|fake|mock|fixture|test"
_OTHER_IDS = "commit|sha1|sha256|revision|checksum|md5|hash|uuid|request|digest|etag|order|isbn|serial"

FEATURES = ("length", "kinds", "coverage", "transitions", "digits", "capitals", "distinct", "hex", "prefix", "assigned", "against", "other_id", "path_against", "quoted", "dashes")


#: Size of the dictionary: the most frequent words of all texts. Transitions are counted over all words, whatever its size.
LANGUAGE_WORDS = 2000


@dataclass(frozen=True)
class Language:
    """A dictionary, and the mean log probability of each letter after each, 26 x 26 in alphabetical order."""

    words: frozenset[str]
    transitions: tuple[float, ...]

    def coverage(self, value: Column) -> Column:
        """Share of the value's characters in words of the dictionary; words end at other characters and where a capital follows a small letter."""
        parts = F.split(F.lower(F.regexp_replace(value, "([a-z])([A-Z])", "$1 $2")), "[^a-z]+")
        known = F.filter(parts, lambda p: p.isin(sorted(self.words)))
        return F.aggregate(known, F.lit(0), lambda a, p: a + F.length(p)) / F.greatest(F.length(value), F.lit(1))

    def likelihood(self, value: Column) -> Column:
        """Mean log probability of the value's letter pairs, in one pass; that of letters at random where it has none."""
        letters = F.split(F.lower(value), "")
        code = lambda c: F.when(c.between("a", "z"), F.ascii(c) - 97)
        pairs = F.zip_with(letters, F.slice(letters, 2, F.greatest(F.size(letters) - 1, F.lit(0))), lambda a, b: F.get(F.array(*map(F.lit, self.transitions)), code(a) * 26 + code(b)))
        known = F.filter(pairs, lambda x: x.isNotNull())
        return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.size(known)).otherwise(-math.log(26))


def _transitions(pairs: dict[str, float]) -> tuple[float, ...]:
    """Log probabilities of the second letter after the first, each pair counted half once more."""
    letters = [chr(c) for c in range(97, 123)]
    rows = [[pairs.get(a + b, 0.0) + 0.5 for b in letters] for a in letters]
    return tuple(round(math.log(x / sum(row)), 4) for row in rows for x in row)


#: What is known without a corpus: common words, and common pairs of letters as though each had been seen a hundred times.
PLAIN = Language(frozenset(_WORDS.split("|")), _transitions(dict.fromkeys(_PAIRS.split("|"), 100.0)))


def learned_language(docs: DataFrame, findings: DataFrame | None = None, text: str = "text", words: int = LANGUAGE_WORDS) -> Language:
    """Dictionary and transitions of all texts, equal ones counted once, and of the false alarms among labelled findings.

    The dictionary has the ``words`` most frequent words of three letters or more that occur in at least three texts, beside the false alarms' words that occur in three of
    them and the plain ones; transitions count each letter pair of each occurrence of every word that occurs in three texts. Null texts count as empty; no such word leaves the plain transitions.
    """
    split = lambda c: F.split(F.lower(F.regexp_replace(c, "([a-z])([A-Z])", "$1 $2")), "[^a-z]+")
    each = docs.select(F.coalesce(docs[f"`{text}`"].cast("string"), F.lit("")).alias("content")).distinct().select(F.array_sort(split(F.col("content"))).alias("words"))
    # A text's words in order: one that differs from the word before it is the text's first of its kind.
    marked = F.zip_with("words", F.concat(F.array(F.lit("")), F.col("words")), lambda word, before: F.struct(word.alias("word"), (word != before).cast("long").alias("first")))
    found = each.select(F.explode(marked).alias("w")).select("w.*").where("length(word) >= 3")
    counts = found.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.sum("first").alias("texts")).where("texts >= 3").select("word", "n")
    counts = counts.repartition(16).persist()  # each part sends the driver its own most frequent words
    try:
        frequent = [r["word"] for r in counts.orderBy(F.desc("n"), "word").limit(words).collect()]
        pairs = counts.select("n", F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substr("word", i, F.lit(2)))).alias("pair"))
        seen = {r["pair"]: r["n"] for r in pairs.groupBy("pair").agg(F.sum("n").alias("n")).collect()}  # 26 x 26 at most
    finally:
        counts.unpersist()
    known = set(frequent) | PLAIN.words
    if findings is not None:
        wrong = findings.where("label = 0").select(F.explode(F.array_distinct(split(F.coalesce(F.col("candidate"), F.lit(""))))).alias("word")).where("length(word) >= 3")
        often = wrong.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n >= 3")
        known |= {r["word"] for r in often.orderBy(F.desc("n"), "word").limit(words).collect()}
    plain = dict.fromkeys(_PAIRS.split("|"), 1.0)
    return Language(frozenset(known), _transitions({p: plain.get(p, 0.0) + seen.get(p, 0) for p in plain.keys() | seen.keys()}) if seen else PLAIN.transitions)


def features(candidate: Column, before: Column, after: Column, path: Column, language: Language = PLAIN) -> list[Column]:
    """The numbers that the forest sees, in the order of ``FEATURES``."""
    size = F.greatest(F.length(candidate), F.lit(1)).cast("double")
    flag = lambda condition: F.when(condition, 1.0).otherwise(0.0)
    share = lambda pattern, text: (size - F.length(F.regexp_replace(text, pattern, ""))) / size
    runs = F.length(F.regexp_replace(candidate, "[a-z]+|[A-Z]+|[0-9]+|[^A-Za-z0-9]+", "x"))
    return [
        size, runs / size, language.coverage(candidate), language.likelihood(candidate), share("[0-9]", candidate), share("[A-Z]", candidate), F.size(F.array_distinct(F.split(candidate, ""))) / size,
        flag(candidate.rlike("^[0-9a-fA-F]+$")), flag(candidate.rlike("^(?:AKIA|ASIA|gh[pousr]_|xox[abprs]-|sk-|eyJ|-----BEGIN)")), flag(before.rlike(f"{_KEY}$")), flag(F.lower(F.concat_ws(" ", before, candidate, after)).rlike(_AGAINST)),
        flag(F.lower(before).rlike(rf"(?:{_OTHER_IDS})\W{{0,3}}$")), flag(F.lower(F.coalesce(path, F.lit(""))).rlike(_AGAINST)), flag(before.rlike("[\"']$")), share("[-_/]", candidate),
    ]


def labelled_findings(spark: SparkSession, rows: int = 4200) -> DataFrame:
    """The labelled findings that the registered query trains on: (candidate, before, after, path, label), made by rule from hashes of a counter.

    Half are secrets (issued shapes, assigned and URL passwords with special characters, JWTs, PEM blocks), half the usual false alarms: checksums, identifiers,
    numbers, placeholders, references, prose, joined words, paths.
    """
    text = lambda value: F.lit(value)
    salted = lambda salt: F.sha2(F.concat(F.col("id").cast("string"), text(salt)), 256)
    hexes, mixed = salted("a"), F.regexp_replace(F.base64(F.unhex(F.concat(salted("b"), salted("c")))), "[^A-Za-z0-9]", "")
    digits = F.regexp_replace(F.translate(F.concat(salted("d"), salted("e")), "abcdef", "012345"), "[^0-9]", "")
    word = lambda salt: F.element_at(F.split(text("report,section,chapter,release,internationalization,summary,configuration,document,appendix,measurement,inventory,harvest"), ","), (F.pmod(F.xxhash64("id", text(salt)), text(12)) + 1).cast("int"))
    pick = lambda salt, *options: F.element_at(F.array(*map(text, options)), (F.pmod(F.xxhash64("id", text(salt)), text(len(options))) + 1).cast("int"))
    neighbour = pick("n", "of the ", "and ", "see ", "de la ", "with a ", "der ", "")
    keys = lambda salt: pick(salt, 'token = "', "token: ", "password=", "secret = '", "api_key=", "PASSWORD: ", 'TOKEN = "')
    small = F.pmod(F.col("id"), text(1000)).cast("string")
    sign = lambda salt: pick(salt, "&", "!", "@", "#", "%", "$", "*", "^", "?")
    leet = F.translate(F.initcap(word("20")), "aeios", "4310$")
    spoken = F.concat_ws(" ", pick("21", "never", "not", "known to", "what"), pick("22", "the", "a", "his", "our"), word("23"), pick("24", "told", "is", "and", "of"), word("25"))
    any_case = F.when(F.pmod(F.xxhash64("id", text("26")), text(2)) == 0, mixed).otherwise(F.lower(mixed))
    block = F.concat(text("-----BEGIN "), pick("27", "", "RSA ", "EC ", "OPENSSH ", "ENCRYPTED "), text("PRIVATE KEY-----\n"), F.regexp_replace(F.repeat(F.concat(mixed, F.reverse(mixed)), F.pmod(F.xxhash64("id", text("28")), text(20)).cast("int") + 2), "(.{64})", "$1\n"), text("\n-----END PRIVATE KEY-----"))
    url = pick("29", "postgres://app:", "https://deploy:", "redis://:", "mongodb://root:", "amqp://svc:")
    shapes = [
        (1, F.substring(hexes, 1, 40), keys("1")), (1, F.substring(hexes, 1, 18), keys("2")), (1, F.concat(text("AKIA"), F.substring(F.upper(mixed), 1, 16)), neighbour), (1, F.substring(mixed, 1, 32), keys("3")),
        (1, F.concat(text("ghp_"), F.substring(mixed, 1, 36)), neighbour), (1, F.upper(F.substring(hexes, 1, 40)), keys("4")), (1, F.substring(hexes, 1, 32), keys("5")),
        (1, block, F.when(F.pmod(F.xxhash64("id", text("30")), text(3)) == 0, keys("31")).otherwise(neighbour)), (1, F.concat(text("eyJhbGciOi"), F.substring(mixed, 1, 12), text(".eyJ"), F.substring(mixed, 5, 30), text("."), F.substring(F.reverse(mixed), 1, 40)), pick("32", "Bearer ", "token: ", "see ", "")),
        (1, F.concat(F.substring(any_case, 1, 5), sign("33"), F.substring(any_case, 6, 5)), url), (1, F.concat(F.substring(leet, 1, 8), sign("34"), F.substring(digits, 1, 2), F.substring(any_case, 1, 3)), keys("35")),
        (1, F.concat(F.substring(any_case, 1, 4), sign("36"), F.substring(any_case, 5, 3), sign("37")), keys("38")), (1, F.concat(F.substring(leet, 1, 7), sign("39")), keys("40")),
        (0, spoken, keys("41")), (0, F.concat(word("42"), pick("43", "", "s", "-", "_"), word("44")), keys("45")), (0, word("46"), keys("47")), (0, pick("48", "password", "example", "changeme", "placeholder", "secret", "${PASSWORD}", "{{password}}"), url),
        (0, F.concat(pick("49", "${", "$", "{{ ", "%(", "os.environ[", "config."), pick("50", "API_TOKEN", "PASSWORD", "db_password", "secret_key", "user.token"), pick("51", "}", "", " }}", ")s")), keys("52")),
        (0, F.substring(digits, 1, 16), neighbour), (0, F.substring(hexes, 1, 40), pick("6", "commit ", "sha1: ", "checksum ", "revision ")),
        (0, F.concat_ws("-", F.substring(hexes, 1, 8), F.substring(hexes, 9, 4), F.substring(hexes, 13, 4), F.substring(hexes, 17, 12)), pick("7", "uuid ", "request ", "id of ", "order ")),
        (0, F.concat(word("8"), pick("9", "-", "_"), word("10"), pick("11", "-", "_"), small), neighbour), (0, F.concat(pick("12", "your-token-here-", "changeme", "example-secret-", "xxxxxxxxxxxxxxxx", "password", "placeholder-"), small), keys("13")),
        (0, F.concat(pick("14", "src/main/java/", "docs/", "assets/images/"), word("15"), text("/"), word("16"), small), neighbour), (0, F.concat(pick("17", "2024-01-", "2023-11-"), F.substring(digits, 1, 2), text("T12-00-"), F.substring(digits, 3, 2), text("-000")), neighbour),
    ]
    kind = F.pmod(F.col("id"), text(len(shapes)))
    choose = lambda k: F.coalesce(*(F.when(kind == i, s[k] if k else text(s[0])) for i, s in enumerate(shapes)))
    path = pick("18", "src0", "src5", "src12", "app/config", "tests/fixtures/data")
    return spark.range(rows).select(choose(1).alias("candidate"), choose(2).alias("before"), pick("19", '"', " ", ", ", ".", '"!! ').alias("after"), path.alias("path"), choose(0).cast("double").alias("label"))


@dataclass(frozen=True)
class Forest:
    """Fitted trees, and the language of their features: an inner node is (feature, threshold, left, right), a leaf the probability of a secret."""

    trees: tuple
    language: Language = PLAIN

    def score(self, values: Column) -> Column:
        """The mean probability over the trees as one expression over an array of features."""

        def node(n) -> Column:
            if isinstance(n, float):
                return F.lit(n)
            return F.when(F.get(values, F.lit(n[0])) <= n[1], node(n[2])).otherwise(node(n[3]))

        total = node(self.trees[0])
        for tree in self.trees[1:]:
            total = total + node(tree)
        return total / float(len(self.trees))


def train_forest(findings: DataFrame, trees: int = 20, depth: int = 5, seed: int = 11, language: Language = PLAIN) -> Forest:
    """Fits a forest on labelled findings (candidate, before, after, path, label); null texts count as empty, null labels are left out.

    Without a finding nothing is a secret; with findings of one label alone, that label is the answer to every candidate.
    """
    named = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("candidate", "before", "after", "path")}
    rows = findings.where("label is not null").select(array_to_vector(F.array(*features(*named.values(), language))).alias("features"), F.col("label").cast("double").alias("label"))
    kinds = [r["label"] for r in rows.select("label").distinct().collect()]
    if len(kinds) < 2:
        return Forest((float(kinds[0]) if kinds else 0.0,), language)
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed).fit(rows)

    def read(node):
        if node.subtreeDepth() == 0:
            stats = list(node.impurityStats().stats())
            return float(stats[1] / max(sum(stats), 1e-9)) if len(stats) > 1 else 0.0
        return (node.split().featureIndex(), float(node.split().threshold()), read(node.leftChild()), read(node.rightChild()))

    return Forest(tuple(read(t._call_java("rootNode")) for t in model.trees), language)


def _found(docs: DataFrame, forest: Forest, keep: list[str], text: str = "text", path: str | None = "source", threshold: float = 0.5, near: int = 40) -> DataFrame:
    """The columns ``keep`` as one struct ``row`` beside the text's ``hits``, ``gaps`` (the texts between them) and ``findings``."""
    content = F.coalesce(docs[text].cast("string"), F.lit(""))
    place = docs[path].cast("string") if path and path in docs.columns else F.lit("")
    found = docs.select(F.struct(*(docs[f"`{c}`"] for c in keep)).alias("row"), content.alias("content"), place.alias("path"))
    found = found.withColumn("gaps", F.split("content", CANDIDATE, -1))
    found = found.withColumn("hits", F.when(F.size("gaps") > 1, F.regexp_extract_all("content", F.lit(CANDIDATE), F.lit(0))).otherwise(F.array().cast("array<string>")))

    def describe(hit: Column, i: Column) -> Column:
        key = F.regexp_extract(hit, f"^{_KEY}", 0)
        before = F.concat(F.right(F.get("gaps", i), F.lit(near)), key)
        after = F.left(F.get("gaps", i + 1), F.lit(near))
        value = F.substr(hit, F.length(key) + 1)
        return F.struct(F.length(key).alias("skip"), value.alias("secret"), F.array(*features(value, before, after, F.col("path"), forest.language)).alias("values"))

    def finding(seen: Column, i: Column, begin: Column) -> Column:
        score, value = forest.score(seen["values"]), seen["secret"]
        kind = F.when(value.startswith("-----BEGIN"), "private_key").when(value.rlike("^(?:AKIA|ASIA)"), "access_key").when(seen["skip"] > 0, "assigned").otherwise("token")
        start = begin + F.length(F.get("gaps", i)) + seen["skip"]
        return F.struct(kind.alias("kind"), start.cast("long").alias("start"), F.length(value).cast("long").alias("length"), value.alias("secret"), score.alias("score"), (score >= threshold).alias("is_secret"))

    steps = F.transform("hits", lambda hit, i: (F.length(F.get("gaps", i)) + F.length(hit)).cast("long"))
    described = found.withColumn("seen", F.transform("hits", describe))
    findings = _once(_sums_before(steps), lambda begin: F.transform("seen", lambda seen, i: finding(seen, i, F.get(begin, i))))
    return described.withColumn("findings", findings).drop("seen")


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once a row, however often and deep inside other lambdas it occurs."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _sums_before(numbers: Column, run: int = 128) -> Column:
    """For each number the sum of those before it: sums of runs, sums of these, and sums inside a run, so that many numbers cost little more each."""
    added = lambda some: F.aggregate(some, F.lit(0).cast("long"), lambda a, x: a + x)
    piece = lambda items, r, n: F.slice(items, r * run + 1, n)

    def placed(items: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.floor(F.size(items) / run).cast("int")), lambda r: added(piece(items, r, F.lit(run))))
        bases = _once(runs, lambda sums: F.transform(sums, lambda _, r: added(F.slice(sums, F.lit(1), r))))
        number = lambda i: F.floor(i / run).cast("int")
        return _once(bases, lambda base: F.transform(items, lambda _, i: F.get(base, number(i)) + added(piece(items, number(i), i % run))))

    return _once(numbers, placed)


def with_findings(docs: DataFrame, forest: Forest, **options) -> DataFrame:
    """The input's rows and columns and ``findings``: array<struct<kind, start, length, secret, score, is_secret>>, in order of place.

    Places are characters from 0 and cover the value alone, not the key before it. A null or empty text has none. Without a path column the path is empty.
    """
    return _found(docs, forest, docs.columns, **options).select("row.*", "findings")


def secret_findings(docs: DataFrame, forest: Forest, **options) -> DataFrame:
    """One row for each candidate: doc_id, place, kind, SHA-256 of the value, score and verdict. Repeated rows repeat theirs; an empty table gives none."""
    # The outer form: before a plain explode Spark filters on the array's size, and works the findings out once more for that, patterns inside lambdas and all.
    each = _found(docs, forest, ["doc_id"], **options).select(F.col("row.doc_id").alias("doc_id"), F.explode_outer("findings").alias("f")).where("f is not null")
    return each.select("doc_id", "f.kind", "f.start", "f.length", F.sha2(F.col("f.secret").cast("binary"), 256).alias("secret_sha256"), "f.score", "f.is_secret")


def redacted(docs: DataFrame, forest: Forest, text: str = "text", mark: str = "<SECRET>", **options) -> DataFrame:
    """The same rows and columns with every secret's value replaced by ``mark``; a column n_chars follows the new text. Null texts stay null."""
    found = _found(docs, forest, docs.columns, text=text, **options)

    def kept(hit: Column, i: Column) -> Column:
        finding = F.get("findings", i)
        head = F.left(hit, F.length(hit) - finding["length"].cast("int"))
        return F.concat(F.get("gaps", i), F.when(finding["is_secret"], F.concat(head, F.lit(mark))).otherwise(hit))

    joined = F.concat(F.array_join(F.transform("hits", kept), ""), F.element_at("gaps", -1))
    hit = F.exists("findings", lambda f: f["is_secret"])
    out = found.select("row", F.when(hit, joined).alias("new"))
    changed = {text: F.col("new")} | ({"n_chars": F.length("new").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return out.select(*(F.when(F.col("new").isNotNull(), changed[c]).otherwise(F.col("row")[c]).alias(c) if c in changed else F.col("row")[c].alias(c) for c in docs.columns))
