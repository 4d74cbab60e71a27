"""Secret scan: candidates by pattern, false positives removed by a random forest."""

from __future__ import annotations

import hashlib
import math
import random
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Words of text, code and settings, for the dictionary coverage.
DICTIONARY = """about access account address admin after again alpha also always another answer application array assert author
backup because before below between block board body boolean bottom branch browser buffer build bundle button cache call cancel
change channel character check child class clean clear client close cloud cluster code column command comment commit common
company complete component config connect console const content context control convert cookie copy core count country create
current custom data database date debug default define delete demo dependency description design detail develop device digest
document domain double download draft driver dummy edit element email empty enable encode engine entry error event example
exception execute exist export extension factory false field file filter final find first float folder font footer format forward
frame from function general generate global google graph group guide handle hash have header health height hello help hidden
history home host html http https icon image import include index info initial inline input insert install instance integer
interface internal invalid item java join json just label language large last layout left length level library light limit line
link linux list live load local location lock logger login long machine main make manager manual master match matrix media member
memory menu merge message meta method middle minute mobile mode model module monitor month more mount name native network next node
none normal note null number object offset only open option order origin other output owner package page panel param parent parse
part password path pattern payload people person phone placeholder plain platform player please plugin point policy port position
post power prefix preview primary print private process product production profile program project property provider proxy public
query queue random range read record redirect reference region register release remote remove render replace report request
reset resource response result return right role root route sample save schema screen script search secret section secure select
sender server service session setting setup share short show sign simple single site size small sort source space spec stack
stage standard start state static status step stop storage store stream string style submit success super support switch symbol
system table target task team temp template test text that theme there this thread time title today token tool topic total track
train true type under unique unit update upload user util valid value variable vector version view visible warning watch water
website week when where which while width window with without word work world write year your""".split()
# Neighbouring words that speak for and against a secret.
SECRET_WORDS = ("token", "secret", "passw", "pwd", "apikey", "api_key", "api-key", "auth", "credential", "access_key", "private", "bearer", "key")
OTHER_WORDS = ("commit", "sha", "md5", "checksum", "digest", "uuid", "guid", "revision", "etag", "order", "invoice", "phone", "card", "isbn", "tracking", "version", "hash", "id")

_VALUE = r"A-Za-z0-9+/=_\-.~"
#: A value set to a name that speaks of secrets, or a long run with a digit, whose parts dots may join, as in signed web tokens.
_NAMES = r"(?i:token|secret|passw(?:or)?d|pwd|api[_-]?key|auth(?:orization)?|credential|access[_-]?key|private[_-]?key|bearer)"
_SET = re.compile(
    rf"{_NAMES}[\"']?\s{{0,3}}(?:[:=]|=>|\s)\s{{0,3}}[\"']?(?P<set>[{_VALUE}!@#%^&*]{{8,}})"
)
_RUN = r"A-Za-z0-9+/=_\-"
#: The body of a private key in its armour, as a whole, and the password of an address.
_KEY = r"-----BEGIN (?:(?!PRIVATE KEY)[A-Z0-9]++ )*+PRIVATE KEY(?: BLOCK)?-----(?P<key>[^-]++(?:-(?!----)[^-]*+)*+)-----END "
_PASSWORD = r"://[^\s/:@]++:(?P<password>[^\s/@]{6,}+)@"
_CANDIDATE = re.compile(rf"{_KEY}|{_PASSWORD}|{_SET.pattern}|(?<![{_RUN}~])(?P<bare>[{_RUN}]{{16,}}(?:\.[{_RUN}]{{6,}})*)")
#: Where a name begins; names have 13 characters at most.
_NAME, _LONGEST_NAME = re.compile(f"(?={_NAMES})"), 13
_DIGIT = re.compile("[0-9]")
#: What every text with a candidate has, for a first look by Spark itself.
FIRST_LOOK = r"(?i)token|secret|passw|pwd|api[_-]?key|auth|credential|access[_-]?key|private[_-]?key|bearer|[a-z0-9+/=_-]{16}|-BEGIN |://[^\s/:@]+:[^\s/@]{6}"
FEATURES = ("length", "digits", "capitals", "small", "marks", "transitions", "distinct", "entropy", "hex", "dictionary", "vowels", "path", "address", "secret_words", "other_words", "quoted", "assigned", "dots")

_BY_LENGTH = {n: frozenset(w for w in DICTIONARY if len(w) == n) for n in range(4, 14)}


def coverage(value: str) -> float:
    """Share of characters covered by dictionary words, longest first from the left."""
    low, at, covered = value.lower(), 0, 0
    while at < len(low):
        for n in range(13, 3, -1):
            if low[at : at + n] in _BY_LENGTH[n]:
                covered += n
                at += n
                break
        else:
            at += 1
    return covered / max(1, len(value))


def features(text: str, start: int, end: int) -> list[float]:
    """Numbers of the candidate text[start:end] and its neighbourhood, in the order of FEATURES."""
    value, before, after = text[start:end], text[max(0, start - 40) : start], text[end : end + 20]
    n = max(1, len(value))
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "m" for c in value]
    share = {k: kinds.count(k) / n for k in "dulm"}
    counts = [value.count(c) for c in set(value)]
    near = (before[-24:] + " " + after[:8]).lower()
    words = re.findall(r"[a-z_\-]+", near)
    return [
        float(min(n, 200)), share["d"], share["u"], share["l"], share["m"],
        sum(a != b for a, b in zip(kinds, kinds[1:])) / n,
        len(counts) / n,
        -sum(c / n * math.log2(c / n) for c in counts),
        sum(c in string.hexdigits for c in value) / n,
        coverage(value),
        sum(c in "aeiouAEIOU" for c in value) / n,
        float(value.count("/") + value.count("\\")) + float(bool(re.search(r"[/\\]$", before))),
        float(bool(re.search(r"(://|www\.|@)\S*$", before)) or "://" in value or after[:1] == "@"),
        float(any(w in near for w in SECRET_WORDS)),
        float(any(x in words for x in OTHER_WORDS)),
        float(before[-1:] in "\"'" and before != ""),
        float(bool(re.search(r"[:=]\s*[\"']?$", before))),
        float(value.count(".")),
    ]


def labelled_findings(count: int = 3000, seed: int = 7) -> list[tuple[str, int, int, int]]:
    """(text, start, end, label) of made-up findings whose labels are known: keys and passwords in settings against hashes of files,
    numbers, paths, addresses, identifiers, placeholders and words."""
    r = random.Random(seed)
    pick = lambda alphabet, n: "".join(r.choice(alphabet) for _ in range(n))
    word = lambda: r.choice(DICTIONARY)
    names = ("token", "api_key", "secret", "password", "access_key", "auth_token", "SECRET_KEY", "client_secret", "apikey", "TOKEN")
    marks = (' = "', '="', ": ", "=", ' => "', ": '")
    b64, out = string.ascii_letters + string.digits + "+/", []
    for _ in range(count):
        around = " ".join(word() for _ in range(r.randint(0, 6)))
        if r.random() < 0.5:
            value = r.choice((
                lambda: pick("0123456789abcdef", r.choice((32, 40, 48, 64))), lambda: pick("0123456789ABCDEF", r.choice((32, 40, 64))), lambda: pick(b64, r.randint(20, 64)), lambda: "AKIA" + pick(string.ascii_uppercase + string.digits, 16),
                lambda: r.choice(("ghp_", "sk_live_", "xoxb-", "pk_test_")) + pick(string.ascii_letters + string.digits, r.randint(24, 40)), lambda: pick(string.ascii_letters + string.digits + "!@#%^&*", r.randint(10, 20)),
                lambda: pick(string.ascii_letters + string.digits, 40),
            ))()
            lead = r.choice(names) + r.choice(marks) if r.random() < 0.9 else "Authorization: Bearer "
            label = 1
        else:
            kind = r.randrange(9)
            hexes = lambda n: pick("0123456789abcdef", n)
            lead, value = [
                lambda: (r.choice(("commit ", "sha256: ", "md5 = ", "checksum: ", "digest = ", "etag: ")), hexes(r.choice((32, 40, 64)))),
                lambda: (r.choice(("", "", "order ", "card ", "phone: ", "invoice ")), pick(string.digits, r.choice((16, 16, 18, 20)))),
                lambda: (r.choice(("", "path: ", "file = ")), "/".join([word() for _ in range(r.randint(2, 5))]) + "/v" + pick(string.digits, 2)),
                lambda: ("https://" + word() + ".example.com/", "-".join([word() for _ in range(3)]) + "-" + pick(string.digits, 4)),
                lambda: (r.choice(("uuid: ", "id = ", "")), "-".join(hexes(k) for k in (8, 4, 4, 4, 12))),
                lambda: (r.choice(names) + r.choice(marks), r.choice(("your_" + word() + "_here", "changeme_" + word(), "xxxxxxxxxxxxxxxx", "example-" + word() + "-" + word(), "placeholder_" + word(), "<" + word() + ">" * 3 + word()))),
                lambda: (r.choice(names) + r.choice((" ", " of ", ": ")), word() + word() + r.choice(("", word()))),
                lambda: (r.choice(("", "const ", "version ")), word() + "_" + word() + "_" + word() + pick(string.digits, r.randint(1, 3))),
                lambda: ("", pick(string.digits, 4) + "-" + pick(string.digits, 2) + "-" + pick(string.digits, 2) + "T" + pick(string.digits, 6)),
            ][kind]()
            label = 0
        text = f"{around} {lead}{value}" if r.random() < 0.8 else f"{lead}{value}"
        start = len(text) - len(value)
        quote = '"' if '"' in lead[-2:] else "'" if "'" in lead[-2:] else ""
        out.append((text + quote + r.choice(("", " ", "\n")) + " ".join(word() for _ in range(r.randint(0, 4))), start, start + len(value), label))
    url = string.ascii_letters + string.digits + "-_"
    for _ in range(count // 8):
        before, after, label = r.choice(("", word() + " ")), r.choice((" ", "\n", "")), 1
        lead, value, tail = r.choice((
            lambda: (r.choice(("", "Cookie: ", word() + "=", "jwt: ", "session ")), "eyJ" + pick(url, r.randint(14, 40)) + ".eyJ" + pick(url, r.randint(30, 120)) + "." + pick(url, 43), ""),
            lambda: ("-----BEGIN " + r.choice(("", "RSA ", "EC ")) + "PRIVATE KEY-----", "\n" + "\n".join(pick(b64, 64) for _ in range(r.randint(2, 20))) + "\n", "-----END PRIVATE KEY-----"),
            lambda: (r.choice(("postgres", "mysql", "amqp", "https")) + "://" + word() + ":", pick(string.ascii_letters + string.digits + "!#%^&*-_", r.randint(8, 24)), "@" + word() + ".example.com:5432/" + word()),
        ))()
        if r.random() < 0.4:
            lead, value, tail, label = *r.choice((
                lambda: ("", ".".join(word() + "_" + word() + pick(string.digits, 2) + word() for _ in range(r.randint(2, 3))), ""),
                lambda: ("https://" + word() + ":", r.choice(("password", "changeme", "<password>", "xxxxxxxx", "${" + word().upper() + "}", word() + word())), "@" + word() + ".example.com/"),
                lambda: ("", word() + "-" + word() + "-" + pick(string.digits, 8) + "." + word() + word(), ""),
            ))(), 0
        out.append((before + lead + value + tail + after + word(), len(before + lead), len(before + lead + value), label))
    return out


@dataclass
class Forest:
    """Trees as arrays of feature, threshold, left, right and share of secrets; feature -1 marks a leaf."""

    trees: list

    def scores(self, x):
        import numpy as np

        total = np.zeros(len(x))
        for feature, threshold, left, right, share in self.trees:
            at = np.zeros(len(x), dtype=np.int64)
            while True:
                inner = feature[at] >= 0
                if not inner.any():
                    break
                rows = np.flatnonzero(inner)
                node = at[rows]
                at[rows] = np.where(x[rows, feature[node]] <= threshold[node], left[node], right[node])
            total += share[at]
        return total / max(1, len(self.trees))


def train_forest(x, y, trees: int = 25, depth: int = 9, least: int = 4, seed: int = 3) -> Forest:
    """Bootstrap rows for each tree; at each node the best Gini split among a random square root of the features."""
    import numpy as np

    rng = np.random.default_rng(seed)
    x, y = np.asarray(x, dtype=float), np.asarray(y, dtype=float)
    tries = max(1, int(round(math.sqrt(x.shape[1]))))

    def grow(rows, level, nodes) -> int:
        me = len(nodes)
        nodes.append([-1, 0.0, 0, 0, float(y[rows].mean())])
        if level == depth or len(rows) < 2 * least or nodes[me][4] in (0.0, 1.0):
            return me
        best = None
        for f in rng.choice(x.shape[1], tries, replace=False):
            order = np.argsort(x[rows, f], kind="stable")
            v, ones = x[rows, f][order], np.cumsum(y[rows][order])
            n = np.arange(1, len(rows) + 1)
            ok = np.flatnonzero((v[1:] > v[:-1]) & (n[:-1] >= least) & (len(rows) - n[:-1] >= least))
            if len(ok):
                a, na = ones[ok], n[ok]
                b, nb = ones[-1] - a, len(rows) - na
                impurity = a * (na - a) / na + b * (nb - b) / nb
                k = int(impurity.argmin())
                if best is None or impurity[k] < best[0]:
                    best = (impurity[k], f, (v[ok[k]] + v[ok[k] + 1]) / 2)
        if best is None:
            return me
        _, f, t = best
        go = x[rows, f] <= t
        nodes[me][0], nodes[me][1] = int(f), float(t)
        nodes[me][2] = grow(rows[go], level + 1, nodes)
        nodes[me][3] = grow(rows[~go], level + 1, nodes)
        return me

    out = []
    for _ in range(trees):
        nodes: list = []
        grow(rng.integers(0, len(y), len(y)), 0, nodes)
        cols = list(zip(*nodes))
        out.append((np.array(cols[0]), np.array(cols[1]), np.array(cols[2]), np.array(cols[3]), np.array(cols[4])))
    return Forest(out)


def default_forest(findings: list[tuple[str, int, int, int]] | None = None) -> Forest:
    findings = labelled_findings() if findings is None else findings
    return train_forest([features(t, a, z) for t, a, z, _ in findings], [label for *_, label in findings])


def candidates(text: str) -> Iterator[tuple[int, int]]:
    """Spans of candidates in a whole text, from the left, without overlap, in time proportional to its length."""
    at = 0
    while m := _CANDIDATE.search(text, at):
        if m.lastgroup == "bare" and not _DIGIT.search(text, m.start(), m.end()):
            # a run without a digit is none, but a name may be set within it
            names = (k.start() for k in _NAME.finditer(text, m.start(), m.end() + _LONGEST_NAME) if k.start() < m.end())
            inner = next(filter(None, (_SET.match(text, k) for k in names)), None)
            if inner is None:
                at = m.end()
                continue
            m = inner
        yield m.span(m.lastgroup)
        at = m.end()


def scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", forest: Forest | None = None, threshold: float = 0.5) -> DataFrame:
    """One row for each candidate in docs: doc_id, start, end (code points), value_sha256, score, is_secret.

    A candidate is a value set to a name, a long run with a digit (with the parts that dots join to it), the password of an address, or all between the
    first and last line of a private key.

    Candidates whose score is below the threshold are false positives (is_secret false). Values are given as hashes, so that a
    report does not spread secrets. Null and empty texts have none; repeated rows are reported each. Texts go through
    whole. Other columns of docs are ignored. An empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(forest or default_forest())
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("value_sha256", pa.string()), ("score", pa.float64()), ("is_secret", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for b in batches:
            found, x = [], []
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for a, z in candidates(t):
                    found.append((d, a, z, hashlib.sha256(t[a:z].encode("utf-8", "surrogatepass")).hexdigest()))
                    x.append(features(t, a, z))
            if found:
                score = shared.value.scores(np.array(x))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([*zip(*found), score.tolist(), (score >= threshold).tolist()], schema)], schema=schema)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where(F.col("text").rlike(FIRST_LOOK))
    return rows.mapInArrow(run, "doc_id long, start long, end long, value_sha256 string, score double, is_secret boolean")
