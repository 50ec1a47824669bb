"""Secret scan: candidates by pattern, false positives removed by a random forest.

Candidates are long runs of key-like characters with a digit, or without one
after the name of a secret (in any of four languages), quoted values of eight
characters or more after such a name, values in the address of a server, and
private keys, from their first line to their last. Features of a
candidate and its line (length, character transitions, dictionary coverage,
path, neighbouring words) feed a forest trained from labelled findings. Trained
trees become nested CASE expressions, so the scan is one pass of column
expressions over the text: no join, no shuffle, no Python on the executors.
"""

from __future__ import annotations

import random
import string

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.scratch import named, renamed

#: Names of secrets, in English, German, French and Spanish.
KEYWORDS = "secret|token|passw|pwd|api.?key|access.?key|private|credential|auth|bearer|kennwort|geheim|schl(?:ue|ü)ssel|mot de passe|cl[eé] (?:secr|priv|d.acc)|jeton|contrase(?:ñ|n)a|clave"
_RUN = "A-Za-z0-9_+/.-"
_AFTER = rf"(?i:{KEYWORDS})[A-Za-zéèñü_]{{0,12}}[\"']?[ \t]{{0,2}}[=:][ \t]{{0,2}}"
_NAMED = rf"(?<={_AFTER}[\"']?)"
#: Stands for a line feed within a key of several lines; a text that has the first as a character of its own takes the second.
FEEDS = ("\ue000", "\ue001")
_HEADER = "-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----"
_FOOTER = "-----END [A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----"


def _key(feed: str) -> str:
    """A private key whose lines end with ``feed``: up to its last line, or where that is missing while lines look like its body."""
    return rf"{_HEADER}(?:[A-Za-z0-9+/=:,.()@<> \t{feed}-]{{0,40000}}?{_FOOTER}|(?:{feed}[A-Za-z0-9+/=]{{16,}}){{0,400}})"


#: '=' ends a candidate unless it pads its end, so that NAME=value gives the value.
#: Runs without a digit count after a secret's name; private keys and values in an address always.
CANDIDATE = "|".join((
    _key("".join(FEEDS).join("[]")),
    # what is cheap to see is looked at first
    r"(?<=:)(?=[^\s/@:]{6,64}@)(?<=[A-Za-z][A-Za-z0-9+.-]{1,20}://[^\s:/@]{1,64}:)[^\s/@:]{6,64}(?=@)",
    rf"(?<=[\"'])(?=[^\s\"']{{8,}}[\"'])(?<={_AFTER}[\"'])[^\s\"']{{8,}}(?=[\"'])",
    rf"(?<![{_RUN}])(?=[{_RUN}]{{16}})(?:(?=[A-Za-z_+/.-]*+[0-9])|{_NAMED})[{_RUN}]{{16,}}(?:={{1,2}}(?![{_RUN}=]))?",
))
LEAST = 6  #: characters of the shortest candidate

#: Dictionary of the coverage feature.
DICTIONARY = (
    "access", "admin", "after", "before", "build", "client", "commit", "config", "content", "data", "default", "demo", "docs", "document", "download", "dummy",
    "example", "file", "fixture", "foo", "from", "here", "home", "html", "http", "image", "index", "insert", "item", "key", "local", "main", "module", "name",
    "number", "order", "page", "password", "path", "placeholder", "project", "public", "release", "replace", "report", "sample", "secret", "section", "service",
    "source", "test", "text", "the", "this", "token", "update", "user", "value", "version", "with", "your",
)

CONTEXT = 60  #: characters before a candidate that count as its neighbours

FEATURES = ("length", "digits", "upper", "transitions", "coverage", "path", "keyword", "assigned", "distinct", "prefix", "harmless", "hex", "quoted", "symbols")


def feature_columns(c: Column, before: Column) -> list[Column]:
    """Doubles, in the order of FEATURES."""
    n = F.length(c)
    share = lambda pattern: F.regexp_count(c, F.lit(pattern)) / n
    flag = lambda x: x.cast("double")
    return [
        n.cast("double"),
        share("[0-9]"),
        share("[A-Z]"),
        share("(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])"),
        (n - F.length(F.regexp_replace(F.lower(c), "|".join(DICTIONARY), ""))) / n,
        share("[/.]"),
        flag(F.lower(before).rlike(rf"({KEYWORDS})[^\n]{{0,24}}$")),
        flag(before.rlike(r"[=:]\s*[\"']?$")),
        F.size(F.array_distinct(F.split(c, ""))) / n,
        flag(c.rlike(r"^(AKIA|ASIA|gh[opsu]_|sk_|pk_|xox[abpr]-|AIza|glpat-|eyJ|-----BEGIN )")),
        flag(F.lower(before).rlike(r"(commit|sha|md5|checksum|hash|uuid|digest|revision|order|card|isbn|phone|fax|ticket|tracking|invoice)[^\n]{0,24}$")),
        flag(c.rlike("^[0-9a-fA-F]+$")),
        flag(before.rlike("[\"']$")),
        share("[^A-Za-z0-9_+/.=-]"),
    ]


def structured_findings(n: int = 1000, seed: int = 4) -> list[tuple[str, str, int]]:
    """Findings of more forms, as ``labelled_findings``: whole private keys,
    values in addresses, short quoted values, names in four languages."""
    r = random.Random(seed)
    pick = lambda alphabet, k: "".join(r.choice(alphabet) for _ in range(k))
    alnum, b64 = string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/"
    names = ["password", "passwort", "kennwort", "mot de passe", "contraseña", "clave", "secret", "clé secrète", "cle secrete", "geheim", "token", "jeton", "schlüssel", "db_password"]
    words = [w for w in DICTIONARY if len(w) > 3]
    out = []
    for _ in range(n // 8):
        kind, f = r.choice(["", "RSA ", "EC ", "OPENSSH ", "ENCRYPTED "]), FEEDS[0]
        body = f.join(pick(b64, 64) for _ in range(r.randint(3, 40)))
        head = f"-----BEGIN {kind}PRIVATE KEY-----{f}{body}"
        out.append((r.choice([head, f"{head}{f}-----END {kind}PRIVATE KEY-----"]), r.choice(["", "key: ", f"{r.choice(names)} = \""]), 1))
        out.append((pick(alnum + "!$&*_", r.randint(8, 24)), f"{r.choice(['postgres', 'https', 'amqp', 'mongodb+srv', 'redis'])}://{r.choice(words)}:", 1))
        out.append((r.choice(["user", "password", "pass", "example", "secret", "changeme"]), f"{r.choice(['postgres', 'https', 'mysql'])}://{r.choice(['user', 'example', 'name'])}:", 0))
        q = r.choice("\"'")
        mixed = r.choice([lambda: pick(alnum + "!$&*_.-", r.randint(8, 15)), lambda: r.choice(words) + str(r.randint(0, 99)) + pick("!$&*_", 1) + pick(string.ascii_lowercase, 2), lambda: r.choice(".-_ ").strip().join(pick(string.ascii_lowercase, r.randint(4, 8)) for _ in range(r.randint(2, 4))) + pick("!$&*#", 1) + str(r.randint(0, 99))])
        for _ in range(2):
            out.append((mixed(), f"{r.choice(['', '* ', 'the '])}{r.choice(names)}{r.choice([' = ', '=', ': ', chr(34) + ': '])}{q}", 1))
        plain = r.choice(["changeme", "required", "optional", "undefined", "********", "xxxxxxxx", "<password>", "your-password", "example-" + r.choice(words), r.choice(words) + "_" + r.choice(words), "${DB_PASSWORD}", "{{ secret }}".replace(" ", "")])
        out.append((plain, f"{r.choice(names)}{r.choice([' = ', '=', ': '])}{q}", 0))
        out.append((pick("0123456789abcdef", r.choice([32, 40])), f"{r.choice(names)}{r.choice([': ', ' = ', '='])}", 1))
    return [x for x in out if len(x[0]) >= LEAST]


def labelled_findings(n: int = 1200, seed: int = 3) -> list[tuple[str, str, int]]:
    """(candidate, text before it on the line, 1 for a real secret), as reviewers
    of scans label them: half real keys, half things that only look like keys."""
    r = random.Random(seed)
    pick = lambda alphabet, k: "".join(r.choice(alphabet) for _ in range(k))
    hexa, alnum, b64 = "0123456789abcdef", string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/"
    words = [w for w in DICTIONARY if len(w) > 3]
    prose = lambda: " ".join(r.choice(words) for _ in range(r.randint(0, 5)))
    names = ["token", "secret", "api_key", "apikey", "password", "access_key", "auth_token", "client_secret", "private_key", "credential"]
    out = []
    for _ in range(n // 2):
        c = r.choice([lambda: pick(hexa, r.choice([32, 40, 64])), lambda: pick(alnum, r.randint(20, 64)), lambda: "AKIA" + pick(string.ascii_uppercase + string.digits, 16), lambda: "ghp_" + pick(alnum, 36), lambda: "sk_live_" + pick(alnum, 24), lambda: pick(b64, r.randint(32, 64)) + r.choice(["", "=", "=="])])()
        q = r.choice(['"', "'", ""])
        out.append((c, f"{prose()} {r.choice(names)}{r.choice([' = ', '=', ': ', ' : '])}{q}", 1))
        kind = r.randrange(8)
        bare = f"{prose()} "
        if kind == 0:
            c, b = pick(string.digits, r.choice([16, 18, 20])), bare + r.choice(["", "card ", "order ", "tracking number "])
        elif kind == 1:
            c, b = "-".join(pick(hexa, k) for k in (8, 4, 4, 4, 12)), bare + r.choice(["uuid ", "id: ", "request "])
        elif kind == 2:
            c, b = pick(hexa, r.choice([32, 40, 64])), bare + r.choice(["commit ", "sha1: ", "md5 = ", "checksum: ", "revision "])
        elif kind == 3:
            c, b = "/".join(r.choice(words) for _ in range(r.randint(3, 6))) + str(r.randint(0, 99)) + r.choice([".html", ".py", ""]), bare
        elif kind == 4:
            c, b = r.choice(["your", "example", "sample", "dummy", "test", "replace"]) + "_" + r.choice(words) + "_" + r.choice(["key", "token", "secret"]) + "_" + str(r.randint(0, 999)), f"{prose()} {r.choice(names)} = \""
        elif kind == 5:
            c, b = r.choice(words) + "-" + r.choice(words) + "-" + ".".join(str(r.randint(0, 20)) for _ in range(3)) + "-" + r.choice(words), bare
        elif kind == 6:
            c, b = "".join(r.choice(words) for _ in range(r.randint(2, 4))) + str(r.randint(0, 9999)), bare + r.choice(["", "name: "])
        else:
            c, b = f"{r.randint(1990, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}T{r.randint(10, 23)}.{r.randint(10, 59)}.{r.randint(10, 59)}", bare + r.choice(["", "at ", "date: "])
        if len(c) >= 16:
            out.append((c, b, 0))
    for _ in range(n // 24):
        out.append((f"-----BEGIN {r.choice(['', 'RSA ', 'EC ', 'OPENSSH ', 'ENCRYPTED '])}PRIVATE KEY-----", r.choice(["", "", f"{prose()} {r.choice(names)} = \""]), 1))
        out.append((pick(string.ascii_letters, r.randint(20, 48)), f"{prose()} {r.choice(names)}{r.choice([' = ', '=', ': '])}{r.choice(['', chr(34)])}", 1))
        c = r.choice("_-.").join(r.choice(words) for _ in range(r.randint(3, 5)))
        out.append((c, f"{prose()} {r.choice(names)}{r.choice([' = ', '=', ': '])}{r.choice(['', chr(34)])}", 0))
    return [x for x in out if len(x[0]) >= 16]


# ---- the forest --------------------------------------------------------------


def grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int, least: int = 4):
    """Nested (feature, threshold, left, right) by Gini, or a leaf's share of 1."""
    share = float(y.mean())
    if depth == 0 or len(y) < 2 * least or share in (0.0, 1.0):
        return share
    best = None
    for f in rng.choice(x.shape[1], max(1, int(np.sqrt(x.shape[1]))) + 1, replace=False):
        o = np.argsort(x[:, f], kind="stable")
        v, c = x[o, f], np.cumsum(y[o])
        at = np.flatnonzero(v[1:] != v[:-1]) + 1
        at = at[(at >= least) & (at <= len(y) - least)]
        if not len(at):
            continue
        l1, n = c[at - 1], len(y)
        r1 = c[-1] - l1
        gini = 2 * l1 * (1 - l1 / at) + 2 * r1 * (1 - r1 / (n - at))
        k = int(np.argmin(gini))
        if best is None or gini[k] < best[0]:
            best = (gini[k], int(f), float((v[at[k] - 1] + v[at[k]]) / 2))
    if best is None:
        return share
    _, f, t = best
    left = x[:, f] <= t
    return f, t, grow(x[left], y[left], rng, depth - 1, least), grow(x[~left], y[~left], rng, depth - 1, least)


def train_forest(x: np.ndarray, y: np.ndarray, trees: int = 15, depth: int = 5, seed: int = 5) -> list:
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(trees):
        rows = rng.integers(0, len(y), len(y))
        out.append(grow(x[rows], y[rows], rng, depth))
    return out


def tree_column(node, features: list[Column]) -> Column:
    if isinstance(node, float):
        return F.lit(node)
    f, t, left, right = node
    return F.when(features[f] <= t, tree_column(left, features)).otherwise(tree_column(right, features))


_FORESTS: dict[tuple, list] = {}


def forest(spark: SparkSession, findings: list[tuple[str, str, int]] | None = None, trees: int = 15, depth: int = 5, seed: int = 5) -> list:
    """A forest from labelled findings (ours by default). The features of the
    training rows come from the same expressions as those of the scan."""
    key = (None if findings is None else tuple(findings), trees, depth, seed)
    if key not in _FORESTS:
        rows = findings or labelled_findings() + structured_findings()
        df = spark.createDataFrame([(i, c, b) for i, (c, b, _) in enumerate(rows)], "i int, c string, b string")
        got = df.select("i", F.array(*feature_columns(F.col("c"), F.col("b"))).alias("x")).collect()
        x = np.array([r["x"] for r in sorted(got, key=lambda r: r["i"])])
        _FORESTS[key] = train_forest(x, np.array([y for _, _, y in rows]), trees, depth, seed)
    return _FORESTS[key]


# ---- the scan ------------------------------------------------------------------


def _whole_keys(t: Column, kept_lines: bool) -> Column:
    """Line feeds within private keys become the character of ``FEEDS`` that the
    text does not hold, so that a key is in one line. With ``kept_lines`` as many
    line feeds follow the key, so that later lines keep their numbers."""

    def joined(feed: str) -> Column:
        key = _key("\n")
        clean = F.regexp_replace(t, "\r\n", "\n") if not kept_lines else F.regexp_replace(t, "\r(?=\n)", " ")
        blocks, rest = F.regexp_extract_all(clean, F.lit(key), F.lit(0)), F.split(clean, key, -1)
        after = lambda b: F.repeat(F.lit("\n"), F.length(b) - F.length(F.replace(b, F.lit("\n"), F.lit("")))) if kept_lines else F.lit("")
        one = F.transform(blocks, lambda b: F.concat(F.translate(b, "\n", feed), after(b)))
        return F.array_join(F.zip_with(rest, F.concat(one, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")

    return F.when(~t.rlike(_HEADER), t).when(F.instr(t, FEEDS[0]) == 0, joined(FEEDS[0])).otherwise(joined(FEEDS[1]))


def _cut_line(t: Column) -> Column:
    """A line as the candidates in it (m) and what stands around them (p, one more)."""
    return F.struct(F.regexp_extract_all(t, F.lit(CANDIDATE), F.lit(0)).alias("m"), F.split(t, CANDIDATE, -1).alias("p"))


def _judged(x: Column, trees: list) -> Column:
    """Array of structs (candidate, score), one for each occurrence in a cut line."""

    def row(c: Column, i: Column) -> Column:
        # so many candidates fill the context at most
        k = range(-(-CONTEXT // LEAST), 0, -1)
        before = F.concat_ws("", *(y for j in k for y in (F.get(x["p"], i - j), F.get(x["m"], i - j))), F.get(x["p"], i))
        return F.struct(c.alias("candidate"), F.array(*feature_columns(c, F.right(before, F.lit(CONTEXT)))).alias("x"))

    def score(f: Column) -> Column:
        each = [tree_column(t, [f[i] for i in range(len(FEATURES))]) for t in trees]
        return sum(each[1:], each[0]) / len(trees)

    return F.transform(F.transform(x["m"], row), lambda r: F.struct(r["candidate"].alias("candidate"), score(r["x"]).alias("score")))


def findings_column(text: Column, trees: list) -> Column:
    """Array of structs (line, candidate, score) of a text; null gives an empty one."""
    lines = F.filter(F.transform(F.split(_whole_keys(F.coalesce(text, F.lit("")), True), "\n", -1), lambda t, i: F.struct(i.alias("line"), t.alias("t"))), lambda x: x["t"].rlike(CANDIDATE))
    cut = F.transform(lines, lambda x: F.struct(x["line"].alias("line"), _cut_line(x["t"]).alias("cut")))
    return F.flatten(F.transform(cut, lambda x: F.transform(_judged(x["cut"], trees), lambda r: F.struct(x["line"].alias("line"), r["candidate"].alias("candidate"), r["score"].alias("score")))))


def scan(docs: DataFrame, threshold: float = 0.5, findings: list | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per occurrence of a candidate: doc_id, line (from 0), candidate,
    score and is_secret. Texts that are null, empty or without a candidate give
    no row; texts and lines of any length are read whole; repeated rows repeat
    theirs; a null doc_id is kept; other columns are not looked at; an empty
    table gives no rows."""
    trees = forest(docs.sparkSession, findings)
    own = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.explode(findings_column(F.col(f"`{text}`").cast("string"), trees)).alias("f"))
    found = F.translate(F.col("f.candidate"), "".join(FEEDS), "\n\n")
    return own.select("doc_id", F.col("f.line").alias("line"), F.when(found.startswith("-----BEGIN "), found).otherwise(F.col("f.candidate")).alias("candidate"), F.col("f.score").alias("score"), (F.col("f.score") >= threshold).alias("is_secret"))


def redact(docs: DataFrame, threshold: float = 0.5, findings: list | None = None, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with each confirmed occurrence of a secret replaced by ``mark``
    where it stands; all else as it was, every row and column, whatever the
    columns' names. Null and empty texts stay as they are; repeated rows are
    redacted alike; an empty table gives no rows."""
    trees = forest(docs.sparkSession, findings)

    def clean(x: Column) -> Column:
        said = F.concat(F.transform(x["f"], lambda f: F.when(f["score"] >= threshold, F.lit(mark)).otherwise(f["candidate"])), F.array(F.lit("")))
        return F.array_join(F.zip_with(x["p"], said, lambda a, b: F.concat(a, b)), "")

    lines = F.transform(F.split(_whole_keys(F.col("t"), False), "\n", -1), lambda t: F.struct(t.alias("t"), F.when(t.rlike(CANDIDATE), _cut_line(t)).alias("cut")))
    judged = F.transform(lines, lambda x: F.struct(x["t"].alias("t"), F.when(x["cut"].isNotNull(), F.struct(x["cut"]["p"].alias("p"), _judged(x["cut"], trees).alias("f"))).alias("g")))
    done = F.array_join(F.transform(judged, lambda x: F.when(x["g"].isNull(), x["t"]).otherwise(clean(x["g"]))), "\n")
    plain, back = renamed(docs)
    own = plain.withColumn("t", F.col(back[text]).cast("string"))
    # a key that was not confirmed gets its line feeds back
    feed = F.when(F.instr("t", FEEDS[0]) == 0, F.lit(FEEDS[0])).otherwise(F.lit(FEEDS[1]))
    done = F.when(F.col("t").rlike(_HEADER), F.replace(done, feed, F.lit("\n"))).otherwise(done)
    return own.withColumn(back[text], F.when(F.col("t").rlike(CANDIDATE), done).otherwise(F.col("t"))).select(*named(back))
