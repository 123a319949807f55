"""Secret scans: candidates by pattern, false positives removed by a random forest, all in SQL functions.

Lines with a digit, ':' or '=' (or a header) are searched for candidates: headers of private keys, passwords in
URLs, quoted values (of any characters, from 6 up) assigned to a word like "password", and runs of at
least 12 characters of keys and tokens that hold a digit or follow such a word. For each candidate,
expressions compute features: length, character transitions, the share covered by a dictionary, signs
of a path, and the words around it (`context` characters before it, half as many after). A random
forest of small trees, fitted on labelled findings from a generator (example_findings), is turned into
CASE expressions, so scanning runs in the JVM alone; findings at or above the threshold stay.

Patterns never go back over a long run, and places come from sums over blocks of gaps, so that very
long lines cost little more than their length.

The fit is on the driver, over the fixed number of generated findings; their features come from the
same expressions as those of documents.

Defined results: a null text has no findings; null sources count as empty; repeated rows give their
findings again; extra columns are not read. Places are line numbers and code points in the line, from
0, end exclusive; lines end at line feeds.
"""

from __future__ import annotations

import json
import random
import uuid as uuids
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tried in this order at each place: a private key's header, a URL's password, a quoted value, a run.
CANDIDATE = "|".join((
    r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----",
    r"(?<=:)(?<=[a-z]://[^\s:/@]{1,40}:)[^\s:/@]{3,80}+(?=@)",
    r"(?<=[\"'`])(?<=(?i:password|passwd|pwd|secret|token|key|credential)[\"'`]?\s{0,3}[:=]{1,2}\s{0,3}[\"'`])[^\s\"'`]{6,200}+(?=[\"'`])",
    r"[A-Za-z0-9+/_\-]{12,}+={0,2}",
))
THRESHOLD, TREES, DEPTH, CONTEXT = 0.5, 15, 5, 60
#: Gaps of a line that are summed as one when places are found.
GAPS = 256
#: Words that announce a secret, words that announce something harmless, prefixes of
#: well-known kinds of key, and a dictionary of common parts of names and words.
SECRET_WORDS = ("token", "secret", "password", "passwd", "pwd", "apikey", "api_key", "api-key", "access_key", "private_key", "auth", "bearer", "credential", "key")
HARMLESS_WORDS = ("commit", "sha", "sha1", "sha256", "md5", "checksum", "digest", "hash", "uuid", "guid", "revision", "build", "image", "phone", "card", "order", "invoice", "id", "isbn", "version", "etag")
KEY_PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "glpat-", "sk_live_", "rk_live_", "xoxb-", "xoxp-", "AIza", "eyJ", "npm_", "hf_")
DICTIONARY = ("the", "and", "tion", "ing", "for", "with", "that", "this", "from", "have", "are", "was", "not", "but", "user", "name", "data", "file", "path", "test", "example", "sample", "config", "value", "index", "table", "query", "http", "https", "www", "com", "org", "html", "json", "java", "python", "class", "function", "return", "string", "number", "object", "list", "array", "public", "private", "static", "final", "import", "export", "default", "module", "package", "version", "release", "your", "here", "insert", "change", "replace", "placeholder", "password", "secret", "token", "key", "api", "access", "account", "service", "server", "client", "request", "response", "error", "debug", "info", "log", "en", "er", "st", "ch", "on", "an", "re", "at", "es", "or", "ti", "ed", "th", "nt", "he", "in")

FEATURES = ("length", "digits", "upper", "hex", "changes", "spoken", "distinct", "dictionary", "path", "secret_near", "assigned", "harmless_near", "quoted", "prefix", "placeholder", "uuid", "plain_number", "test_source", "marks", "pem", "url_login")


def _any(words: tuple[str, ...]) -> str:
    return "|".join(words)


def _features(c: Column, left: Column, right: Column, source: Column) -> dict[str, Column]:
    n = F.char_length(c).cast("double")
    low, near = F.lower(c), F.lower(left)
    share = lambda pattern: F.regexp_count(c, F.lit(pattern)) / n
    flag = lambda condition: condition.cast("double")
    return {
        "length": n,
        "digits": share("[0-9]"),
        "upper": share("[A-Z]"),
        "hex": flag(low.rlike("^[0-9a-f]+$")),
        "changes": share("(?<=[0-9])[A-Za-z]|(?<=[A-Za-z])[0-9]|(?<=[a-z])[A-Z]"),
        "spoken": F.regexp_count(low, F.lit("(?<=[aeiou])[b-df-hj-np-tv-z]|(?<=[b-df-hj-np-tv-z])[aeiou]")) / n,
        "distinct": F.size(F.filter(F.array(*(F.lit(chr(i)) for i in range(33, 127))), lambda x: F.contains(c, x))) / n,
        "dictionary": 1 - F.char_length(F.regexp_replace(low, _any(DICTIONARY), "")) / n,
        "path": flag(left.rlike(r"(?:https?:|[/\\.~])[^\s]*$") | c.rlike(r"^/|(?<![A-Za-z_\-])[A-Za-z_\-]{3,}+/[A-Za-z_\-]{3,}+/") | right.rlike(r"^\.[a-z]{2,4}\b")),
        "secret_near": flag(near.rlike(rf"(?:{_any(SECRET_WORDS)})[^a-z0-9]*(?:[a-z]+[^a-z0-9]+)?$") | near.rlike(rf"(?:{_any(SECRET_WORDS)})\S{{0,3}}\s*[:=]\s*\S?$")),
        "assigned": flag(left.rlike("[:=]\\s*[\"'`]?$")),
        "harmless_near": flag(near.rlike(rf"\b(?:{_any(HARMLESS_WORDS)})[^a-z0-9]*$")),
        "quoted": flag(left.rlike("[\"'`]$") & right.rlike("^[\"'`]")),
        "prefix": flag(c.rlike(f"^(?:{_any(KEY_PREFIXES)})")),
        "placeholder": flag(low.rlike(r"x{4,}|0{6,}|example|sample|changeme|your|placeholder|insert|1234567|abcdef")),
        "uuid": flag(low.rlike("^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")),
        "plain_number": flag(c.rlike(r"^[0-9\-]+$")),
        "marks": F.regexp_count(c, F.lit(r"[^A-Za-z0-9]")) / n,
        "pem": flag(c.rlike("^-----BEGIN ")),
        "url_login": flag(left.rlike(r"[a-z]://[^\s:/@]{1,40}:$") & right.rlike("^@")),
        "test_source": flag(F.lower(source).rlike("test|example|fixture|sample")),
    }


def candidates(docs: DataFrame, *, context: int = CONTEXT, id_col: str = "doc_id", text_col: str = "text", source_col: str | None = None) -> DataFrame:
    """A row a candidate: doc_id, line, start, end, candidate, left, right (words around it), source."""
    source = F.coalesce(F.col(source_col).cast("string"), F.lit("")) if source_col else F.lit("")
    lines = docs.select(F.col(id_col).alias("doc_id"), source.alias("source"), F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("line", "content"))
    lines = lines.where(F.col("content").rlike("[0-9:=]|-----BEGIN "))
    hits = lines.withColumn("hits", F.regexp_extract_all("content", F.lit(CANDIDATE), 0)).where(F.size("hits") > 0).withColumn("gaps", F.split("content", CANDIDATE, -1))
    # where a hit starts: sums of whole blocks of (gap, hit) lengths before it, then of its own block's
    hits = hits.withColumn("steps", F.transform("hits", lambda c, i: F.char_length(c) + F.char_length(F.get("gaps", i))))
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    hits = hits.withColumn("blocks", F.transform(F.sequence(F.lit(0), F.expr(f"(size(hits) - 1) div {GAPS}").cast("int")), lambda k: total(F.slice("steps", k * GAPS + 1, GAPS))))
    hits = hits.withColumn("before", F.transform("blocks", lambda _, k: total(F.slice("blocks", 1, k))))
    place = lambda i: F.get("before", F.floor(i / GAPS).cast("int")) + total(F.slice("steps", i - i % GAPS + 1, i % GAPS)) + F.char_length(F.get("gaps", i))
    each = F.transform("hits", lambda c, i: F.struct(c.alias("candidate"), i.alias("i"), F.right(F.get("gaps", i), F.lit(context)).alias("left"), F.left(F.get("gaps", i + 1), F.lit(context // 2)).alias("right")))
    announced = rf"(?:{_any(SECRET_WORDS)})[^a-z0-9]{{0,3}}\s*[:=]?\s*[\"'`]?$|://[^\s:/@]{{1,40}}:$"
    good = F.filter(each, lambda x: x.candidate.rlike("[0-9]|^-----") | F.lower(x.left).rlike(announced))
    placed = F.transform(good, lambda x: F.struct(x.candidate.alias("candidate"), x.left.alias("left"), x.right.alias("right"), place(x.i).alias("start")))
    found = hits.select("doc_id", "line", "source", F.explode(placed).alias("f"))
    return found.select("doc_id", "line", F.col("f.start").alias("start"), (F.col("f.start") + F.char_length("f.candidate")).alias("end"), F.col("f.candidate").alias("candidate"), F.col("f.left").alias("left"), F.col("f.right").alias("right"), "source")


def with_features(found: DataFrame) -> DataFrame:
    return found.withColumns(_features(F.col("candidate"), F.col("left"), F.col("right"), F.col("source")))


def example_findings(n: int = 2400, seed: int = 3) -> list[tuple[str, str, int]]:
    """Labelled findings (line, source, 1 if the line's longest candidate is a secret), made by rule."""
    r = random.Random(seed)
    hexes = lambda k: "".join(r.choice("0123456789abcdef") for _ in range(k))
    mixed = lambda k: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(k))
    parts = [w for w in DICTIONARY if len(w) > 1 and w not in SECRET_WORDS]
    signs = lambda k: "".join(r.choice("ABCDEFGHKMPQRSTXYZabcdefghkmnpqrstxyz23456789!#$%&*+.?@^~") for _ in range(k))
    login = lambda value: f"{prose()} {r.choice(('postgres', 'https', 'amqp', 'redis', 'mysql'))}://{r.choice(('app', 'root', 'admin', 'svc'))}:{value}@{word()}.com/{word()} {prose()}"
    word = lambda: "".join(r.choice(parts) for _ in range(r.randint(1, 4)))
    prose = lambda: " ".join(word() for _ in range(r.randint(0, 8)))
    out = []
    for _ in range(n // 2):
        key = r.choice(SECRET_WORDS)
        key = r.choice((key, key.upper(), "my_" + key, key + "_id", "client " + key))
        if (u := r.random()) < 0.06:
            kind = r.choice(("", "RSA ", "EC ", "OPENSSH ", "ENCRYPTED "))
            out.append((f"-----BEGIN {kind}PRIVATE KEY-----", r.choice(("src1", "app/config", "web", "tests/unit")), 1))
            continue
        if u < 0.14:
            out.append((login(signs(r.randint(8, 20)).replace("@", "9").replace(":", "7")), r.choice(("src1", "app/config", "web")), 1))
            continue
        if u < 0.26:
            name = r.choice(("password", "passwd", "pwd", "secret", "db_password", "PASSWORD"))
            out.append((f"{prose()} {name}{r.choice((' = ', '=', ': '))}\"{signs(r.randint(8, 20))}\" {prose()}", r.choice(("src1", "app/config", "web")), 1))
            continue
        value = r.choice((hexes(r.choice((32, 40, 48, 64))), mixed(r.randint(20, 44)), r.choice(KEY_PREFIXES) + mixed(r.randint(16, 36)), mixed(r.randint(12, 18)) + "-" + mixed(8), mixed(r.choice((22, 42))) + "=="))
        if value.startswith(KEY_PREFIXES) and r.random() < 0.5:
            text = f"{prose()} {value} {prose()}"
        else:
            quote = r.choice(('"', "'", ""))
            text = f"{prose()} {key}{r.choice((' = ', '=', ': ', ' := ', '  = '))}{quote}{value}{quote} {prose()}"
        out.append((text, r.choice(("src1", "app/config", "web", "tests/unit")), 1))
    for _ in range(n - n // 2):
        digits = "".join(r.choice("0123456789") for _ in range(r.choice((12, 13, 16, 19))))
        text = r.choice((
            lambda: f"{r.choice(HARMLESS_WORDS)} {r.choice(('', '= ', ': '))}{hexes(r.choice((32, 40, 64)))}",
            lambda: f"{prose()} {digits} {prose()}",
            lambda: f"{r.choice(('id', 'uuid', 'request', 'token'))} {uuids.UUID(int=r.getrandbits(128))}",
            lambda: f"{r.choice(SECRET_WORDS)} = \"{r.choice(('your_api_key_here_1', 'xxxxxxxxxxxxxxxx1', 'EXAMPLE_TOKEN_1234567', 'changeme12345678', 'insert-token-here-0'))}\"",
            lambda: f"https://{word()}.com/{word()}/{word()}_{r.randint(1, 99)}/{word()}{r.randint(1, 9)}.html",
            lambda: f"{prose()} {word()}_{word()}_{r.randint(1, 2000)}_{word()} {prose()}",
            lambda: f"{word()}{r.randint(1, 99)}{word()}{word()}{r.randint(1, 9)} = {word()}{word()}{r.randint(1, 9)}{word()}",
            lambda: f"{r.choice(('password', 'secret', 'token', 'key'))} = \"{r.choice(('${PASSWORD}', '<password>', 'required', 'not-set', 'none-given', '{{ secret }}', '********', 'enter password'.replace(' ', '_'), '%(password)s'))}\"",
            lambda: login(r.choice(("password", "<password>", "${PASS}", "****", "secret", "xxxx", "%s"))),
            lambda: f"{r.choice(('key', 'auth', 'token', 'secret'))} {word()}{word()}{word()}{word()} {prose()}",
            lambda: f"{prose()} -----BEGIN PUBLIC KEY----- {hexes(12)}",
            lambda: f"key = {word()}_{word()}_{word()}_{r.randint(1, 9)}",
            lambda: f"data:image/png;base64,{mixed(60)}",
            lambda: f"integrity=sha512-{mixed(60)}==",
            lambda: f"{prose()} {r.randint(1000, 9999)}-{r.randint(10, 99)}-{r.randint(10, 99)}T{r.randint(10, 99)} {hexes(6)}-{digits}",
        ))()
        out.append((text, r.choice(("src1", "app/config", "web", "tests/unit")), 0))
    return out


def _grow(x: np.ndarray, y: np.ndarray, depth: int, r: np.random.Generator) -> tuple:
    """A tree: a float (share of secrets) or (feature, cut, low, high), by Gini impurity on random features."""
    if depth == 0 or len(y) < 8 or y.min() == y.max():
        return (float((y.sum() + 0.5) / (len(y) + 1)),)
    best = (np.inf, 0, 0.0)
    for f in r.choice(x.shape[1], size=6, replace=False):
        order = np.argsort(x[:, f], kind="stable")
        v, ones = x[order, f], np.cumsum(y[order])
        at = np.flatnonzero(v[1:] > v[:-1])
        if len(at):
            k = at + 1
            p, q = ones[at] / k, (ones[-1] - ones[at]) / (len(y) - k)
            gini = k * p * (1 - p) + (len(y) - k) * q * (1 - q)
            i = int(gini.argmin())
            best = min(best, (float(gini[i]), int(f), float((v[at[i]] + v[at[i] + 1]) / 2)))
    if best[0] == np.inf:
        return (float((y.sum() + 0.5) / (len(y) + 1)),)
    low = x[:, best[1]] <= best[2]
    return (best[1], best[2], _grow(x[low], y[low], depth - 1, r), _grow(x[~low], y[~low], depth - 1, r))


def grow_forest(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = 5) -> list[tuple]:
    r = np.random.default_rng(seed)
    forest = []
    for _ in range(trees):
        rows = r.integers(0, len(y), len(y))
        forest.append(_grow(x[rows], y[rows], depth, r))
    return forest


def _vote(tree: tuple, features: Column) -> Column:
    if len(tree) == 1:
        return F.lit(tree[0])
    f, cut, low, high = tree
    return F.when(features[FEATURES[f]] <= cut, _vote(low, features)).otherwise(_vote(high, features))


def probability(forest: list[tuple], features: Column) -> Column:
    """The trees' mean vote, as nested CASE expressions over a struct of features."""
    total = _vote(forest[0], features)
    for tree in forest[1:]:
        total = total + _vote(tree, features)
    return total / len(forest)


_FORESTS: dict[str, list[tuple]] = {}


def train(spark: SparkSession, findings: list[tuple[str, str, int]] | None = None) -> list[tuple]:
    """A forest over FEATURES from labelled findings (line, source, label)."""
    own = findings is None
    if own and "" in _FORESTS:
        return _FORESTS[""]
    rows = json.dumps([{"doc_id": i, "text": t, "source": s, "label": y} for i, (t, s, y) in enumerate(findings or _examples())])
    table = spark.range(1).select(F.inline(F.from_json(F.lit(rows), "array<struct<doc_id:long,text:string,source:string,label:int>>")))
    found = with_features(candidates(table, source_col="source")).join(table.select(F.col("doc_id"), "label"), "doc_id")
    got = found.select("doc_id", F.char_length("candidate").alias("n"), "label", *FEATURES).collect()  # at most a few a generated line
    longest: dict[int, tuple] = {}
    for row in sorted(got, key=lambda row: (row.doc_id, row.n)):
        longest[row.doc_id] = row
    x = np.array([[float(row[f]) for f in FEATURES] for row in longest.values()])
    y = np.array([row.label for row in longest.values()], dtype=float)
    forest = grow_forest(x, y)
    if own:
        _FORESTS[""] = forest
    return forest


@lru_cache(maxsize=1)
def _examples() -> tuple:
    return tuple(example_findings())


def scan(docs: DataFrame, forest: list[tuple] | None = None, *, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", source_col: str | None = None) -> DataFrame:
    """A row a finding: doc_id, line, start, end, secret, probability. A map over lines, no shuffle."""
    forest = forest or train(docs.sparkSession)
    found = candidates(docs, id_col=id_col, text_col=text_col, source_col=source_col)
    features = _features(F.col("candidate"), F.col("left"), F.col("right"), F.col("source"))
    # A lambda's argument is computed once, where a projection would be copied into every node of the trees.
    votes = F.transform(F.array(F.struct(*(c.alias(n) for n, c in features.items()))), lambda f: probability(forest, f))
    return found.select("doc_id", "line", "start", "end", F.col("candidate").alias("secret"), F.explode(F.filter(votes, lambda p: p >= threshold)).alias("probability"))
