"""Secret scan whose false positives a random forest removes."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import tidied
from quire.llm.decontaminate import ids_of, word_ids
from quire.llm.quality import _bytes_of, _slices
from quire.llm.sums import SCHEMA as SUMS
from quire.llm.sums import sliced, summed

#: Published forms of keys and tokens.
KNOWN = {
    "aws_key": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])",
    "github_token": r"(?<![A-Za-z0-9])gh[pousr]_[A-Za-z0-9]{36,}",
    "slack_token": r"(?<![A-Za-z0-9])xox[abprs]-[A-Za-z0-9-]{10,}",
    "google_key": r"(?<![A-Za-z0-9])AIza[A-Za-z0-9_-]{35}",
    "stripe_key": r"(?<![A-Za-z0-9])[sr]k_(?:live|test)_[A-Za-z0-9]{16,}",
    "jwt": r"(?<![A-Za-z0-9])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
    "private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
}
_KNOWN = re.compile("|".join(f"(?P<{k}>{v})" for k, v in KNOWN.items()))
_TOKEN = re.compile(r"[A-Za-z0-9+/_=\-]{16,}")
#: A value assigned to a name that tells a secret, of any length and signs: looked for at each sign of assignment.
_ASSIGNED = re.compile(r"""[:=]\s?(?:"([^"\n]+)"|'([^'\n]+)'|([^\s"',;]+))""")
#: Cheap signs that a text may hold a published form.
_SIGNS = ("AKIA", "ASIA", "gh", "xox", "AIza", "k_live_", "k_test_", "eyJ", "-----BEGIN")
#: Words near a secret, near a harmless digest or name, and in placeholders.
SECRET_WORDS = ("password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "api-key", "auth", "credential", "private", "access", "bearer", "key")
HARMLESS_WORDS = ("commit", "sha1", "sha256", "md5", "checksum", "digest", "uuid", "guid", "etag", "revision", "hash", "build", "version", "card", "order", "invoice", "isbn", "phone")
PLACEHOLDERS = ("example", "sample", "dummy", "changeme", "placeholder", "your", "xxxx", "0000", "1234", "abcd", "test", "redacted", "todo")
#: Words that names in code are made of; the words of the corpus are added to them.
DICTIONARY = (
    "access account action address admin alert app area array auth back base batch block body book box branch buffer build button byte cache call card cell change channel char check class client "
    "clock code color column command commit config content control copy core count create custom data date debug default delete device digest display document domain draft edit email enable end engine "
    "entry error event example export factory field file filter final find flag folder form format frame full function game global graph grid group handle hash header height host html icon image "
    "import index info input item java job key kind label layer layout length level line link list load local lock log login loop main map mark master media member memory menu message method mode "
    "model module month name network node note number object offset open option order output owner page param parent part password path payment phone place plan point policy port post price print "
    "process product profile project public query queue random range read record region remote report request reset response result retry role root route row sample scale schema scope score script "
    "search section secret select send sequence server service session set shop size slot sort source stage start state status step stock store stream string style system table tag target task test "
    "text theme thread time title token tool topic total track tree type unit update upload user value version video view week width window word work worker write year zone"
).split()
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: A word of the corpus is known when its hash is so frequent; hashes of words, and the shortest word that counts.
BUCKETS, KNOWN_SHARE, LEAST_LETTERS = 1 << 18, 2e-5, 3
_CONTEXT = 48
FEATURE_NAMES = (
    "length", "entropy", "distinct", "digits", "upper", "lower", "signs", "hex", "kinds", "fluency", "least_fluent", "covered", "longest_run", "steps",
    "path", "slashes", "secret_word", "harmless_word", "placeholder", "assigned", "quoted", "known", "dashes", "only_digits", "vowels", "blanks",
)
TREES, DEPTH, LEAST_LEAF, THRESHOLD = 40, 10, 3, 0.5
#: Labelled findings that a forest is fitted on, at most.
MOST_LABELLED = 20_000


def candidates(text: str) -> list[tuple[int, int, str]]:
    """(start, end, rule) of published forms, of values assigned to telling names, and of long tokens with a digit or assigned."""
    out = []
    if any(s in text for s in _SIGNS):
        out = [(m.start(), m.end(), m.lastgroup) for m in _KNOWN.finditer(text)]
    if ":" in text or "=" in text:
        for m in _ASSIGNED.finditer(text):
            name = re.search(r"[\w-]+[\"']?\s?$", text[max(0, m.start() - 40) : m.start()])
            if name and any(w in name[0].lower() for w in SECRET_WORDS):
                a, b = m.span(m.lastindex)
                if not any(x < b and a < y for x, y, _ in out):
                    out.append((a, b, "assigned"))
    taken = [(a, b) for a, b, _ in out]
    for m in _TOKEN.finditer(text):
        a, b = m.span()
        token = m.group()
        if (token.isalpha() or not any(c.isdigit() for c in token)) and not re.search(r"[=:]\s?[\"']?$", text[max(0, a - 4) : a]):
            cut = token.rfind("=", 0, len(token) - 2)  # name=value in one token
            if cut < 1 or b - a - cut <= 8:
                continue
        if any(x < b and a < y for x, y in taken):
            continue
        out.append((a, b, "token"))
    return sorted(out)


@dataclass
class Words:
    """What a corpus tells about words: odds of letters that follow each other, and frequent words (by hash)."""

    turns: np.ndarray  # logarithms; 0 stands for all that is no letter, 1 to 26 for the letters
    known: np.ndarray

    def covered(self, token: str) -> float:
        """The part of the token's characters that lie in words of the dictionary or of the corpus."""
        parts = [p.lower() for p in _PARTS.findall(token)]
        return sum(len(p) for p in parts if len(p) >= LEAST_LETTERS and (p in _DICTIONARY or bool(self.known[int(ids_of(p)[0]) % BUCKETS]))) / len(token)

    def fluency(self, token: str) -> tuple[float, float]:
        """The mean and the least logarithm of the odds of the token's letter pairs."""
        at = _LETTER[np.frombuffer(token.encode("ascii", "replace"), np.uint8)]
        odds = self.turns[at[:-1], at[1:]]
        return (float(odds.mean()), float(odds.min())) if len(odds) else (0.0, 0.0)


_DICTIONARY = frozenset(DICTIONARY)
_LETTER = np.zeros(256, np.intp)
_LETTER[97:123] = _LETTER[65:91] = np.arange(1, 27)


def words_of(pairs: np.ndarray, hashes: np.ndarray) -> Words:
    """From counts of letter pairs (27 x 27) and of hashed words; the dictionary's own words count once each."""
    pairs = pairs.reshape(27, 27) + 0.5
    for w in DICTIONARY:
        at = _LETTER[np.frombuffer(f" {w} ".encode(), np.uint8)]
        np.add.at(pairs, (at[:-1], at[1:]), 1)
    return Words(np.log(pairs / pairs.sum(axis=1, keepdims=True)), hashes >= np.maximum(2, KNOWN_SHARE * hashes.sum()))


def fit_words(docs: DataFrame) -> Words:
    """The word model of all texts: letter pairs and hashed words are counted where the texts lie and summed up."""
    text = F.concat(F.lower(F.coalesce(F.col("text").cast("string"), F.lit(""))), F.lit("\n"))
    rows = docs.select(text.alias("text"))
    tasks = max(1, len(docs.inputFiles()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS + 1024)
        for batch in batches:
            for a, b in _slices(batch.column(0), 1 << 20):
                data, offsets = _bytes_of(batch.column(0).slice(a, b - a))
                at = _LETTER[data]
                total[BUCKETS : BUCKETS + 729] += np.bincount(27 * at[:-1] + at[1:], minlength=729)
                total[:BUCKETS] += np.bincount(word_ids(data, offsets)[0] % BUCKETS, minlength=BUCKETS)
        yield from sliced(total, 32, tasks)

    got = summed(rows.mapInArrow(tidied(run), SUMS), BUCKETS + 1024, 32, tasks)
    return words_of(got[BUCKETS : BUCKETS + 729], got[:BUCKETS])


def features(text: str, start: int, end: int, rule: str, words: Words) -> list[float]:
    """A candidate's length, characters and their transitions, dictionary coverage, path and neighbouring words."""
    token = text[start:end]
    n = len(token)
    counts: dict[str, int] = {}
    for c in token:
        counts[c] = counts.get(c, 0) + 1
    entropy = -sum(v / n * math.log2(v / n) for v in counts.values())
    digits, upper, lower = (sum(f(c) for c in token) for f in (str.isdigit, str.isupper, str.islower))
    kind = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "s" for c in token]
    turns = sum(x != y for x, y in zip(kind, kind[1:], strict=False))
    low = token.lower()
    vowels = sum(c in "aeiou" for c in low)
    run = best = 1
    steps = 0
    for x, y in zip(token, token[1:], strict=False):
        run = run + 1 if x == y else 1
        best = max(best, run)
        steps += abs(ord(y) - ord(x)) == 1
    before, after = text[max(0, start - _CONTEXT) : start].lower(), text[end : end + 16].lower()
    near = before[-24:]
    ahead = before.rstrip(" \"'")
    mean, least = words.fluency(token)
    return [
        n, entropy, len(counts) / n, digits / n, upper / n, lower / n, (n - digits - upper - lower) / n, all(c in "0123456789abcdef" for c in low), turns / n, mean, least, words.covered(token), best / n, steps / n,
        before.endswith(("/", "\\", ".", "@", "#")) or after.startswith(("/", ".com", ".js", ".py", ".html", "@")), token.count("/"),
        any(w in near for w in SECRET_WORDS), any(w in near for w in HARMLESS_WORDS), any(w in low for w in PLACEHOLDERS),
        ahead.endswith(("=", ":")), before.endswith(("'", '"', "`")), rule not in ("token", "assigned"), token.count("-"), digits == n, vowels / n, token.count(" "),
    ]


@dataclass
class Forest:
    """Trees as arrays: feature (-1 at a leaf), limit, left and right child, and share of secrets."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, limit, left, right, share in self.trees:
            at = np.zeros(len(x), int)
            for _ in range(DEPTH + 1):
                f = feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                low = x[np.arange(len(x)), np.maximum(f, 0)] <= limit[at]
                at = np.where(inner, np.where(low, left[at], right[at]), at)
            total += share[at]
        return total / max(1, len(self.trees))


def _grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
    nodes: list[list[float]] = []

    def split(rows: np.ndarray, depth: int) -> int:
        at = len(nodes)
        share = float(y[rows].mean())
        nodes.append([-1, 0.0, 0, 0, share])
        if depth == DEPTH or len(rows) < 2 * LEAST_LEAF or share in (0.0, 1.0):
            return at
        best = None
        for f in rng.choice(x.shape[1], max(1, round(math.sqrt(x.shape[1]))), replace=False):
            order = rows[np.argsort(x[rows, f], kind="stable")]
            v, ones = x[order, f], np.cumsum(y[order])
            k = np.arange(LEAST_LEAF, len(rows) - LEAST_LEAF + 1)
            k = k[v[k - 1] < v[np.minimum(k, len(v) - 1)]]
            if not len(k):
                continue
            p, q = ones[k - 1] / k, (ones[-1] - ones[k - 1]) / (len(rows) - k)
            impurity = k * p * (1 - p) + (len(rows) - k) * q * (1 - q)
            i = int(np.argmin(impurity))
            if best is None or impurity[i] < best[0]:
                best = (impurity[i], int(f), (v[k[i] - 1] + v[k[i]]) / 2)
        if best is None or best[0] >= len(rows) * share * (1 - share) - 1e-12:
            return at
        low = x[rows, best[1]] <= best[2]
        nodes[at][0], nodes[at][1] = best[1], best[2]
        nodes[at][2] = split(rows[low], depth + 1)
        nodes[at][3] = split(rows[~low], depth + 1)
        return at

    split(rng.integers(0, len(x), len(x)), 0)
    feature, limit, left, right, share = zip(*nodes, strict=True)
    return np.array(feature, int), np.array(limit), np.array(left, int), np.array(right, int), np.array(share)


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, seed: int = 7) -> Forest:
    rng = np.random.default_rng(seed)
    return Forest([_grow(x, y.astype(float), rng) for _ in range(trees)]) if len(x) else Forest([])


def labelled_findings(n: int = 3000, seed: int = 11) -> list[tuple[str, int, int, str, int]]:
    """Labelled findings made by rule: (text, start, end, rule, label). Half are secrets.

    Secrets are random strings of usual alphabets and lengths that are assigned or quoted near a telling word, short
    passwords of letters, digits and signs, or have a published form. The others are what scans take for them: words and
    names (also such as no dictionary has), paths, digests of commits and files, unique ids, numbers, placeholders, and
    words or references to variables that are assigned to telling names.
    """
    r = random.Random(seed)
    hexes, letters, base64 = "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    some = lambda alphabet, k: "".join(r.choice(alphabet) for _ in range(k))
    word = lambda: "".join(r.choice(("th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "nt", "ea", "ti", "to", "it", "st", "io", "le", "is", "ou")) for _ in range(r.randint(1, 5)))
    prose = lambda: " ".join(word() for _ in range(r.randint(3, 9)))
    names = ("token", "api_key", "secret", "password", "access_token", "auth_token", "client_secret", "aws_secret_access_key", "private_key", "apikey", "passwd", "bearer")
    out = []
    for k in range(n):
        rule = "token"
        if k % 2:
            value = r.choice((some(hexes, r.choice((32, 40, 48, 64))), some(base64[:62], r.randint(20, 44)), some(base64, r.choice((40, 44, 64))), some(base64[:62] + "_-", r.randint(24, 48))))
            form = r.random()
            if form < 0.1:
                value, rule = r.choice((("AKIA" + some(base64[:26] + "0123456789", 16), "aws_key"), ("ghp_" + some(base64[:62], 36), "github_token"), ("sk_live_" + some(base64[:62], 24), "stripe_key")))
            elif form < 0.35:  # a short password
                value, rule = "".join(r.choice(base64[:62] + "!#$%&*@?^~.") for _ in range(r.randint(7, 15))), "assigned"
                value = value if any(c.isdigit() for c in value) else value + "7"
            else:
                rule = r.choice(("token", "assigned"))
            said = r.choice(('{} = "{}"', "{}={}", "{}: {}", "{}: '{}'", 'export {}="{}"', '"{}": "{}"')).format(r.choice(names), value)
            text = f"{prose()}{r.choice((' ', chr(10), '### ', '%%% '))}{said} {prose()}"
        else:
            value = r.choice(
                (
                    lambda: some("0123456789", r.randint(16, 19)),
                    lambda: "-".join(some(hexes, m) for m in (8, 4, 4, 4, 12)),
                    lambda: some(hexes, 40),
                    lambda: "/".join(r.choice(DICTIONARY) for _ in range(r.randint(3, 6))) + some("0123456789", 2),
                    lambda: "".join(r.choice(DICTIONARY).title() for _ in range(r.randint(3, 5))) + some("0123456789", r.randint(1, 2)),
                    lambda: "_".join(r.choice(DICTIONARY) for _ in range(r.randint(3, 5))) + some("0123456789", 1),
                    lambda: r.choice(("xxxxxxxxxxxxxxxxxxxx", "your_api_key_here_0000", "0123456789abcdef0123456789abcdef", "example_token_1234567890", "changeme_changeme_1", "AAAAAAAAAAAAAAAAAAAAAAAA1")),
                    lambda: "".join(word() for _ in range(4)) + some("0123456789", 1),
                    lambda: some(letters, r.randint(4, 8)) + "-" + "-".join(r.choice(DICTIONARY) for _ in range(4)) + "-" + some("0123456789", 4),
                    lambda: f"20{some('0123456789', 2)}-{r.randint(10, 12)}-{r.randint(10, 28)}T{r.randint(10, 23)}-00-00",
                    lambda: "".join(word().title() for _ in range(3)) + some("0123456789", r.randint(1, 2)),
                    lambda: "-".join(word() for _ in range(4)) + "-" + some("0123456789", 3),
                )
            )()
            value = value if len(value) >= 16 else value + "_" + some(letters, 16 - len(value))
            place = r.choice(("commit {}", "sha1 {}", "order {}", "see /srv/{}", "https://host.example.com/{}", "{}", "uuid: {}", "checksum = {}", "version={}", "file: {}", '"{}"', "card {}"))
            if all(c in hexes for c in value) and len(value) == 40:
                place = r.choice(("commit {}", "sha1: {}", "/objects/{}", "checksum = {}", "etag: {}", "revision {}"))
            text = f"{prose()} {place.format(value)} {prose()}"
            if r.random() < 0.2:  # harmless values of telling names
                value, rule = r.choice((lambda: word() + word(), lambda: r.choice(DICTIONARY), lambda: "${" + r.choice(DICTIONARY).upper() + "_TOKEN}", lambda: f"get_{r.choice(DICTIONARY)}()", lambda: f"{word()} {word()} {word()}", lambda: r.choice(("none", "null", "true", "required", "********", "<your-key>", "changeme", "xxxxxxxx")), lambda: f"os.environ.{r.choice(DICTIONARY)}"))(), "assigned"
                text = f"{prose()} " + r.choice(('{} = "{}"', "{}: {}", "{}={}")).format(r.choice(names), value) + f" {prose()}"
                out.append((text, start := text.rindex(value), start + len(value), rule, 0))
                continue
        start = text.index(value)
        out.append((text, start, start + len(value), rule, k % 2))
    return out


@dataclass
class Model:
    forest: Forest
    words: Words


def train(words: Words | None = None, labelled: list[tuple[str, int, int, str, int]] | None = None, seed: int = 7) -> Model:
    """A word model and a forest fitted on at most MOST_LABELLED labelled findings (rule-made where none are given)."""
    words = words_of(np.zeros(729), np.zeros(BUCKETS)) if words is None else words
    rows = (labelled_findings() if labelled is None else labelled)[:MOST_LABELLED]
    x = np.array([features(t, a, b, rule, words) for t, a, b, rule, _ in rows], float).reshape(len(rows), len(FEATURE_NAMES))
    return Model(fit(x, np.array([r[4] for r in rows], float), seed=seed), words)


SCHEMA = "doc_id long, start long, length long, rule string, fingerprint string, score double, is_secret boolean"


def scan(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Every candidate of every text, judged: doc_id, start and length in characters, rule, fingerprint, score, is_secret.

    ``fingerprint`` is the first half of the value's SHA-256, so that equal secrets are seen to be equal and none is
    shown. Whole texts are scanned row by row, with no shuffle. Null and empty texts hold nothing; null ids are
    reported as null; repeated rows are reported as often; an empty table gives no rows; other columns take no part.
    """
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.bool_())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                rows, x = [], []
                for doc_id, text in zip(*(c.to_pylist() for c in batch.slice(k, 512).columns), strict=True):
                    for a, b, rule in candidates(text or ""):
                        x.append(features(text, a, b, rule, model.words))
                        rows.append((doc_id, a, b - a, rule, hashlib.sha256(text[a:b].encode()).hexdigest()[:32]))
                if rows:
                    score = model.forest.score(np.array(x, float))
                    columns = [*zip(*rows, strict=True), score.tolist(), (score >= threshold).tolist()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidied(run), SCHEMA)
