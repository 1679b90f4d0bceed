"""Secret scan: candidates by pattern, false positives removed by a random forest.

Native: the scan is one expression over each row, without shuffle or Python.  A
pattern finds runs that mix letters and digits, whatever is assigned to a name that
speaks of secrets, web tokens and private-key blocks; each candidate, what stands before and
after it, and its path (one named shortly before it, else the document's) become
features (length, class transitions, distinct characters, dictionary coverage, path,
neighbouring words); the trees of the forest are CASE expressions over them.
Secrets are replaced where they stand, so the same string judged harmless elsewhere stays.

The forest is trained on labelled findings.  ``training`` reads at most
``MAX_FINDINGS`` of them, in hash order, computes the same expressions and grows
the trees on the driver.  ``generated_findings`` makes a labelled set by rule, for
use where no labelled findings of one's own exist.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A private key with its first and last line.
_BLOCK = r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY-----[\s\S]*?-----END [A-Z0-9 ]{0,40}PRIVATE KEY-----"
#: A JSON web token: header, payload and perhaps a signature.
_WEB = r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}(?:\.[A-Za-z0-9_-]*)?"
#: What a value of at least six characters is assigned to: the candidate begins behind it.
_ASSIGNED = r"(?<![\w-])[\w-]{0,40}?(?i:passw(?:or)?d|pwd|secret|token|api[_-]?key|access[_-]?key|credential)[\w-]{0,24}[\"']?[ \t]{0,3}(?::=|=>|[=:])[ \t]{0,3}[\"'`]?"
_VALUE = r"[^\s\"'`,;&<>(){}\[\]]{6,}"
#: A run of at least 16 characters of keys with a digit and a letter in it; = belongs to it only as padding at its end, so that a key may follow one.
_RUN = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{16,}(?:={1,2}(?![A-Za-z0-9+/_=-]))?"
CANDIDATE = f"{_BLOCK}|{_WEB}|{_ASSIGNED}{_VALUE}|{_RUN}"
#: Characters of context looked at on each side.
CONTEXT = 48
MAX_FINDINGS = 4000
TREES, DEPTH, SEED = 15, 6, 5
LEAST_SCORE = 0.5
REDACTED = "<secret>"
#: Words of identifiers and prose, for dictionary coverage.
DICTIONARY = (
    "access account admin agent alpha author auto backup base batch beta block branch build cache call channel client cloud cluster code column commit common config connect content control "
    "copy count create custom data date debug default deploy dev device doc document download draft edit email engine entry error event example file final first flag folder form format "
    "function group header home host html http image import index info init input item java job json key label last latest layer level library line link list load local log login main map "
    "master media memory menu message meta method migration mode model module month name native network new node note number object old open option order output owner package page parent "
    "part password path patch phase plan point port post print prod product profile project proxy public query queue range read record region release remote report request reset resource "
    "response result role root route row rule run sample schema screen script search section select server service session set size snapshot source stage standard start state static "
    "status step stop store stream string style system table target task team temp template test text theme thread time title token tool topic total track type update upload user util "
    "value version video view web widget window worker world write year zone"
).split()
FEATURES = ("length", "transitions", "distinct", "digits", "upper", "hex", "coverage", "longest_word", "symbols", "odd_path", "assigned", "quoted", "named", "in_link", "harmless", "shaped", "web", "block")
_NAMES = r"(?i)(token|secret|passw|pwd|api.?key|access.?key|private.?key|auth|bearer|credential)[^=:]{0,16}[=:]{1,2}>?\s*[\"'`]?$"
_HARMLESS = r"(?i)(commit|sha-?\d+|md5|checksum|digest|integrity|uuid|guid|etag|revision|build|hash|fingerprint|image|version|ref)\W{0,12}\w{0,8}\W{0,4}$"
_FILE = r"([\w.-]*/[\w./-]*\.[A-Za-z]{1,5})\b"
_PATH = r"(?i)(^|[/_.-])(tests?|examples?|samples?|docs?|fixtures?|mocks?|vendor|locale)([/_.-]|$)"
_UUID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def _features(found: Column) -> Column:
    """Struct of features of a struct (candidate, before, after, path)."""
    c, before, after, path = (found[x] for x in ("candidate", "before", "after", "path"))
    size = F.length(c)
    runs = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[a-z]+", "a"), "[A-Z]+", "B"), "[0-9]+", "0"), "[^aB0]+", "-")
    share = lambda x: x / size
    left_over = F.regexp_replace(F.lower(c), "|".join(sorted(DICTIONARY, key=lambda w: -len(w))), "")
    flag = lambda x: F.when(x, 1.0).otherwise(0.0)
    values = {
        "length": size.cast("double"),
        "transitions": (F.length(runs) - 1) / F.greatest(size - 1, F.lit(1)),
        "distinct": share(F.size(F.array_distinct(F.split(c, "")))),
        "digits": share(F.length(F.regexp_replace(c, "[^0-9]", ""))),
        "upper": share(F.length(F.regexp_replace(c, "[^A-Z]", ""))),
        "hex": flag(F.rlike(c, F.lit("^[0-9a-f]+$")) | F.rlike(c, F.lit("^[0-9A-F]+$"))),
        "coverage": 1 - share(F.length(left_over)),
        "longest_word": F.array_max(F.transform(F.split(c, "[^A-Za-z]+"), lambda w: F.length(w))).cast("double"),
        "symbols": share(F.length(F.regexp_replace(c, "[A-Za-z0-9]", ""))),
        "odd_path": flag(F.rlike(path, F.lit(_PATH))),
        "assigned": flag(F.rlike(before, F.lit("[=:]>?\\s*[\"'`]?$"))),
        "quoted": flag(F.rlike(before, F.lit("[\"'`]$")) & F.rlike(after, F.lit("^[\"'`]"))),
        "named": flag(F.rlike(before, F.lit(_NAMES))),
        "in_link": flag(F.rlike(before, F.lit("(://|www\\.)\\S*$")) | F.rlike(after, F.lit("^\\.[a-z]{2,4}\\b"))),
        "harmless": flag(F.rlike(before, F.lit(_HARMLESS))),
        "web": flag(F.rlike(c, F.lit("^eyJ[A-Za-z0-9_-]{8,}\\."))),
        "block": flag(c.startswith("-----BEGIN ")),
        "shaped": flag(F.rlike(c, F.lit(_UUID)) | F.rlike(c, F.lit(r"^(.)\1{7}|0123456789|(?i)abcdef0?1234|x{6}"))),
    }
    return F.struct(found["candidate"].alias("candidate"), *[values[x].cast("double").alias(x) for x in FEATURES])


class Forest:
    """Random forest of binary trees; leaves hold the share of secrets."""

    def __init__(self, trees: list):
        self.trees = trees

    @classmethod
    def grown(cls, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> Forest:
        draw = np.random.default_rng(seed)
        out = []
        for _ in range(trees):
            pick = draw.integers(0, len(x), len(x))
            out.append(cls._tree(x[pick], y[pick], depth, draw))
        return cls(out)

    @classmethod
    def _tree(cls, x: np.ndarray, y: np.ndarray, depth: int, draw):
        """A leaf's share, or (feature, threshold, below, above) by the least Gini impurity."""
        if depth == 0 or len(y) < 8 or y.min() == y.max():
            return float(y.mean())
        best = None
        for f in draw.choice(x.shape[1], max(1, int(np.sqrt(x.shape[1]) + 1)), replace=False):
            order = np.argsort(x[:, f], kind="stable")
            v, t = x[order, f], np.cumsum(y[order])
            cut = np.flatnonzero(v[1:] > v[:-1]) + 1
            if len(cut):
                left, right = t[cut - 1] / cut, (t[-1] - t[cut - 1]) / (len(y) - cut)
                gini = (cut * left * (1 - left) + (len(y) - cut) * right * (1 - right)) / len(y)
                i = int(gini.argmin())
                if best is None or gini[i] < best[0]:
                    best = (gini[i], int(f), float((v[cut[i]] + v[cut[i] - 1]) / 2))
        if best is None:
            return float(y.mean())
        below = x[:, best[1]] <= best[2]
        return best[1], best[2], cls._tree(x[below], y[below], depth - 1, draw), cls._tree(x[~below], y[~below], depth - 1, draw)

    def column(self, features: Column) -> Column:
        """Mean of all trees over a struct of features."""

        def of(node):
            if isinstance(node, float):
                return F.lit(node)
            f, t, below, above = node
            return F.when(features[FEATURES[f]] <= F.lit(t), of(below)).otherwise(of(above))

        total = of(self.trees[0])
        for tree in self.trees[1:]:
            total = total + of(tree)
        return total / F.lit(float(len(self.trees)))

    def score(self, x: np.ndarray) -> np.ndarray:
        """The same over rows of features."""

        def of(node, row):
            while not isinstance(node, float):
                node = node[2] if row[node[0]] <= node[1] else node[3]
            return node

        return np.array([np.mean([of(t, r) for t in self.trees]) for r in x])


def generated_findings(spark: SparkSession, n: int = 3000, seed: int = SEED) -> DataFrame:
    """Labelled findings by rule: candidate, before, after, path, secret."""
    df = spark.range(n).withColumn("h", F.sha2(F.concat_ws("-", F.lit(seed), "id").cast("binary"), 512))
    pick = lambda i, *x: F.element_at(F.array(*[F.lit(v) if isinstance(v, str) else v for v in x]), (F.conv(F.substring("h", i, 6), 16, 10).cast("long") % len(x) + 1).cast("int"))
    hexa = lambda k: F.substring("h", 41, k)
    base = F.regexp_replace(F.base64(F.unhex(F.substring("h", 33, 96))), "=", "")
    words = [F.lit(w) for w in DICTIONARY]
    word = lambda i: F.element_at(F.array(*words), (F.conv(F.substring("h", i, 4), 16, 10).cast("long") % len(words) + 1).cast("int"))
    number = F.concat(F.conv(F.substring("h", 70, 4), 16, 10))
    secret = F.conv(F.substring("h", 1, 2), 16, 10).cast("int") % 2 == 0
    name = pick(3, "token", "secret", "password", "api_key", "apiKey", "access_key", "auth_token", "client_secret", "PRIVATE_KEY", "credential")
    good = F.struct(
        pick(
            9, hexa(40), hexa(32), hexa(64), F.substring(base, 1, 40), F.substring(base, 1, 24), F.substring(base, 1, 32), F.upper(F.concat(F.lit("AKIA"), F.substring(F.regexp_replace(base, "[+/]", "Q"), 1, 16))),
            F.concat(word(13), F.lit("."), F.substring(base, 1, 3), F.substring("h", 77, 3)), F.concat(F.initcap(word(13)), number, F.lit("!")), F.concat(word(13), number, word(17)), F.regexp_replace(F.substring(base, 1, 30), "[0-9]", "k"), F.concat(F.lit("sk_live_"), F.substring(base, 1, 24)),
        ).alias("candidate"),
        F.concat(pick(15, "", "and ", "export ", "let my ", "the value of "), name, pick(21, " = \"", "=", ": '", ": ", "=\"", " := \"")).alias("before"),
        pick(27, "\"", "'", " and", "\n", "", "\" # set").alias("after"), pick(31, "src3", "app/config.py", "src/main.js", "deploy/env", "docs/setup", "").alias("path"),
    )
    uuid = F.concat_ws("-", F.substring("h", 41, 8), F.substring("h", 49, 4), F.substring("h", 53, 4), F.substring("h", 57, 4), F.substring("h", 61, 12))
    # keys that need no name: web tokens and private keys, wherever they stand
    bare = F.struct(
        pick(9, F.concat(F.lit("eyJ"), F.substring(F.regexp_replace(base, "[+/]", "_"), 1, 30), F.lit(".eyJ"), F.substring(F.regexp_replace(base, "[+/]", "-"), 5, 40), F.lit("."), hexa(43)), F.concat(F.lit("-----BEGIN RSA PRIVATE KEY-----\n"), base, F.lit("\n-----END RSA PRIVATE KEY-----"))).alias("candidate"),
        pick(15, "", "Authorization: Bearer ", "\n", "cookie ", "the key ").alias("before"), pick(27, "", " and", "\n", "\"").alias("after"), pick(31, "src3", "src/main.js", "deploy/env", "").alias("path"),
    )
    # values of names like secrets that are none: words, placeholders, code, paths
    empty = F.struct(
        pick(9, word(13), F.concat(word(13), F.lit("-"), word(17)), F.concat(F.lit("$"), F.upper(word(13))), F.concat(word(13), F.lit("."), word(17)), F.lit("xxxxxxxx"), F.lit("********"), F.lit("changeme"), F.lit("required"), F.concat(F.lit("/"), word(13), F.lit("/"), word(17)), F.concat(word(13), F.lit("_"), word(17))).alias("candidate"),
        F.concat(name, pick(21, " = ", "=", ": ", ": ", "=\"", " is: ")).alias("before"), pick(27, " ", ".", " and", "\n", "", "()", "\"").alias("after"), pick(31, "src3", "app/config.py", "tests/fixtures", "docs/examples", "").alias("path"),
    )
    bad = F.struct(
        pick(9, hexa(40), uuid, F.concat(word(13), F.lit("_"), word(17), F.lit("_"), word(21), number), F.concat(word(13), F.initcap(word(17)), F.initcap(word(21)), number), F.concat(word(13), F.lit("/"), word(17), F.lit("/"), word(21), F.lit("-"), number), F.lit("xxxxxxxxxxxxxxxx0000"), hexa(64), F.concat(word(13), F.lit("-"), word(17), F.lit("-"), word(21), F.lit("-"), number)).alias("candidate"),
        pick(3, "commit ", "see sha256:", "md5 ", "checksum = ", "uuid: ", "build ", "https://host.example/", "of the ", "file name ", "image digest ", "in ", "revision=\"", "etag: \"", "and then ").alias("before"),
        pick(27, " ", ".html", "\"", "", "\n", " and").alias("after"), pick(31, "src3", "tests/fixtures", "docs/examples", "src/main.js", "package/lock", "").alias("path"),
    )
    fifth = F.conv(F.substring("h", 60, 4), 16, 10).cast("int") % 5 == 0
    found = F.when(secret & fifth, bare).when(secret, good).when(fifth, empty).otherwise(bad)
    return df.select(found.alias("f"), secret.alias("secret")).select("f.*", "secret").filter(F.length("candidate") >= 6)


def training(findings: DataFrame) -> Forest:
    """The forest grown from labelled findings (candidate, before, after, path, secret); rows with a null label or candidate are left out."""
    rows = findings.filter("secret is not null and candidate is not null")
    rows = rows.select(F.struct("candidate", *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("before", "after", "path")]).alias("found"), "secret")
    rows = rows.orderBy(F.xxhash64("found"), "secret").limit(MAX_FINDINGS).select(_features(F.col("found")).alias("x"), "secret").collect()
    x = np.array([[r["x"][f] for f in FEATURES] for r in rows], dtype=float).reshape(len(rows), len(FEATURES))
    y = np.array([r["secret"] for r in rows], dtype=float)
    return Forest.grown(x, y) if len(rows) else Forest([0.0])


def _runs(text: Column) -> Column:
    """What the pattern finds, in order; a name and what joins it to its value come along."""
    return F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))


def _led(run: Column) -> Column:
    """Characters of a run before its candidate."""
    name = F.regexp_extract(run, f"^({_ASSIGNED}){_VALUE}$", 1)
    return F.when(F.rlike(run, F.lit(f"^(?:{_BLOCK}|{_WEB})$")), F.lit(0)).otherwise(F.length(name))


def scan(text: Column, path: Column, forest: Forest) -> Column:
    """Array of structs (candidate, score) of a text's candidates in order; empty for null and for texts without one."""
    parts, runs = F.split(text, CANDIDATE, -1), _runs(text)
    # what stands before a run begins with the run before it: a key's name may be a run itself
    led = F.transform(F.arrays_zip(F.concat(F.array(F.lit("")), runs).alias("run"), parts.alias("part")), lambda x: F.concat(x["run"], x["part"]))
    near = F.arrays_zip(
        runs.alias("run"), F.transform(runs, _led).alias("led"),
        F.transform(led, lambda x: F.substr(x, F.greatest(F.lit(1), F.length(x) - CONTEXT + 1))).alias("before"),
        F.slice(F.transform(parts, lambda x: F.substring(x, 1, CONTEXT)), 2, F.size(parts)).alias("after"),
    )
    near = F.filter(near, lambda x: x["run"].isNotNull())
    where = lambda before: F.coalesce(F.nullif(F.regexp_extract(before, _FILE, 1), F.lit("")), path, F.lit(""))
    near = F.transform(near, lambda x: F.struct(
        F.substr(x["run"], x["led"] + 1).alias("candidate"), F.concat(x["before"], F.substr(x["run"], F.lit(1), x["led"])).alias("before"),
        F.coalesce(x["after"], F.lit("")).alias("after"), where(x["before"]).alias("path"),
    ))
    scored = F.transform(F.transform(near, _features), lambda x: F.struct(x["candidate"].alias("candidate"), forest.column(x).alias("score")))
    return F.when(F.rlike(text, F.lit(CANDIDATE)), scored).otherwise(F.array().cast("array<struct<candidate:string,score:double>>"))


def find(docs: DataFrame, forest: Forest, key: str = "doc_id", text: str = "text", path: str = "source") -> DataFrame:
    """One row for each row of ``docs``: key, n_candidates, n_secrets, best score, secrets (hashed) and the redacted text.

    A null text has no candidates and stays null, an empty one stays empty.  Whole
    texts are read, however long.  Repeated rows and keys stay rows of their own;
    an empty table gives none; other columns are left out.
    """
    df = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"), scan(F.col(f"`{text}`").cast("string"), F.col(f"`{path}`").cast("string"), forest).alias("found"))
    held = F.filter("found", lambda x: x["score"] >= LEAST_SCORE)
    return df.select(
        "key", F.size("found").cast("long").alias("n_candidates"), F.size(held).cast("long").alias("n_secrets"),
        F.coalesce(F.array_max(F.transform("found", lambda x: x["score"])), F.lit(0.0)).alias("score"),
        F.transform(held, lambda x: F.sha2(x["candidate"].cast("binary"), 256)).alias("secrets_sha256"), redacted(F.col("text"), F.col("found")).alias("redacted"),
    )


def redacted(text: Column, found: Column) -> Column:
    """The text with every secret in ``found`` (what ``scan`` gives for it) replaced where it stands; all else stays."""
    lead = lambda run, c: F.substr(run, F.lit(1), F.length(run) - F.length(c))
    bits = F.zip_with(_runs(text), found, lambda run, x: F.when(x["score"] >= LEAST_SCORE, F.concat(lead(run, x["candidate"]), F.lit(REDACTED))).otherwise(run))
    both = F.zip_with(F.split(text, CANDIDATE, -1), bits, lambda part, bit: F.concat(part, F.coalesce(bit, F.lit(""))))
    any_ = F.exists(found, lambda x: x["score"] >= LEAST_SCORE)
    return F.when(any_, F.array_join(both, "")).otherwise(text)
