"""Secret scans: fixed patterns, and a linear-chain conditional random field over tokens.

The field tags each white-space token as begin, inside or outside of a secret, from the token's shape,
the neighbouring tokens and features of the whole file, and is decoded by Viterbi. It is trained on a
bounded sample of documents whose tokens are labelled by the fixed patterns, with generated secrets of further
kinds set among them. The sample's bounds are parameters of training alone: about ``sample`` documents, by a hash
of doc_id and text; of each up to ``windows`` stretches of 24 tokens, drawn by a seed from all that cover a
secret or an odd token, and three from anywhere. Every text is scanned whole. Its spans are added where they
touch no span of the patterns. All offsets are code points, ends exclusive.

Defined results: null text is an empty text and has no spans; repeated rows agree; an empty table gives an
empty table (the field is then trained on generated text alone); other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import random
import re
import string
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import crf
from .common import LOWER_AZ, Vocab, binary, slices, tidy

#: The fixed patterns, in the order of their kinds (fixed values).
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "crf")
LEAST = {"assign": 6, "access": 20, "hex": 24}
ASSIGN_HINTS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
HEX_MARK = bytes(49 if chr(b) in "0123456789abcdef" else 48 for b in range(256))

SAMPLE = 400
STORE_WORDS = 200_000
O, B, I = 0, 1, 2
WORD = re.compile(r"[^\x20\x09-\x0D]+")
HINT = re.compile(r"(?i)(passw|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|auth|bearer|credential|private|client[_-]?id|signature)")
VENDOR = re.compile(r"(ghp_|gho_|github_pat_|glpat-|sk_live_|sk_test_|sk-|rk_live_|xox[abprs]-|AIza|ya29\.|eyJ|npm_|pypi-|SG\.|AKIA|ASIA|-----BEGIN|-----END)")
PERSONAL = re.compile(r"[\w.+-]+@[\w-]+\.\w|^\W*\d{1,3}(\.\d{1,3}){3}\W*$|^\W*\+?[\d()./:-]+\W*$")


def patterns(text: str, raw: bytes) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns' matches, by start, then kind."""
    found = []
    low = raw.translate(LOWER_AZ)
    if any(h in low for h in ASSIGN_HINTS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if b"AKIA" in raw:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    if b"1" * LEAST["hex"] in raw.translate(HEX_MARK):
        found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text) if m.end() - m.start() >= LEAST["hex"]]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def bucket(n: float, cuts: tuple[float, ...]) -> int:
    return sum(n >= c for c in cuts)


@lru_cache(maxsize=1 << 14)
def plain_traits(length: int, capital: bool, hint: bool) -> tuple[list[int], list[int], list[int]]:
    """Features of a token of letters and edge punctuation: as itself, as the one before, as the one after."""
    shape = f"letters{capital}"
    return traits_of(shape, bucket(length, (3, 6, 10, 16, 24, 40)), hint, False, False, 0, 0)


def traits_of(shape: str, size: int, hint: bool, vendor: bool, personal: bool, variety: int, digits: int):
    own = [f"o:{shape}", f"o:size{size}", f"o:{shape}:{size}", f"o:hint{hint}", f"o:vendor{vendor}:{size}", f"o:vendor{vendor}", f"o:personal{personal}", f"o:variety{variety}:{size}", f"o:digits{digits}:{size}", "o:bias"]
    return [crf.feature(x) for x in own], [crf.feature(f"p:hint{hint}:{shape}"), crf.feature(f"p:vendor{vendor}:{size}")], [crf.feature(f"n:{shape}:{size}"), crf.feature(f"n:vendor{vendor}")]


def token_traits(word: bytes) -> tuple[list[int], list[int], list[int]]:
    if word.isalpha() or (core := word.strip(b".,;:!?\"'()")).isalpha():
        return plain_traits(min(len(word), 64), word[:1].isupper(), bool(HINT.search(word.decode())))
    text = core.decode("utf-8", "replace") or word.decode("utf-8", "replace")
    if text.isalpha():
        return plain_traits(min(len(text), 64), text[0].isupper(), bool(HINT.search(text)))
    whole = word.decode("utf-8", "replace")
    value = re.split(r"[=:]", whole.rstrip("=\"',;"), maxsplit=1)[-1].strip("\"'`,;()[]{}<>")
    kinds = "".join(k for k, c in (("l", re.search(r"[a-z]", value)), ("u", re.search(r"[A-Z]", value)), ("d", re.search(r"\d", value)), ("s", re.search(r"[+/=_-]", value)), ("x", re.search(r"[^A-Za-z0-9+/=_-]", value))) if c)
    assign = "a" if re.search(r"[=:]", whole) and value else ""
    turns = sum(a != b for a, b in itertools.pairwise(map(kind_of, value))) / max(len(value), 1)
    return traits_of(kinds + assign, bucket(len(value), (3, 6, 10, 16, 20, 24, 32, 40, 64)), bool(HINT.search(whole)), bool(VENDOR.search(whole)), bool(PERSONAL.search(whole)), bucket(len(set(value)) / max(len(value), 1), (0.2, 0.4, 0.6, 0.8)), bucket(turns, (0.05, 0.15, 0.3, 0.45)))


def kind_of(c: str) -> str:
    return "d" if c.isdigit() else "u" if c.isupper() else "l" if c.isalpha() else c


def file_traits(words: int, odd: int) -> list[int]:
    """Features of the whole file: its length and its share of tokens that aren't plain words."""
    return [crf.feature(f"f:len{bucket(words, (20, 100, 1000, 10000))}"), crf.feature(f"f:odd{bucket(odd / max(words, 1), (0.01, 0.05, 0.2, 0.5))}")]


def is_odd(word: bytes) -> bool:
    return not word.strip(b".,;:!?\"'()").isalpha() and any(48 <= b <= 57 or b in b"=_/+" for b in word)


def made_secret(rng: random.Random) -> tuple[list[str], list[int]]:
    """A generated secret with the words that lead to it, and their labels."""
    draw = lambda n, chars=string.ascii_letters + string.digits: "".join(rng.choice(chars) for _ in range(n))
    value = rng.choice([
        lambda: draw(rng.randint(20, 44)), lambda: draw(rng.randint(16, 64), "0123456789abcdef"), lambda: base64.b64encode(rng.randbytes(rng.randint(18, 40))).decode(),
        lambda: "ghp_" + draw(36), lambda: "sk_live_" + draw(24), lambda: "sk-" + draw(40), lambda: "glpat-" + draw(20), lambda: f"xoxb-{draw(11, string.digits)}-{draw(24)}", lambda: "AIza" + draw(35), lambda: "npm_" + draw(36),
        lambda: f"eyJ{draw(30)}.eyJ{draw(50)}.{draw(43)}", lambda: "AKIA" + draw(16, string.ascii_uppercase + string.digits), lambda: draw(rng.randint(8, 14)) + rng.choice("!@#$") + draw(4),
    ])()
    name = rng.choice(["password", "secret", "token", "api_key", "apikey", "passwd", "pwd", "access_key", "client_secret", "auth_token", "private_key", "AWS_SECRET_ACCESS_KEY"])
    quote = rng.choice(["", '"', "'"])
    kind = rng.randrange(6)
    if kind == 0:
        return [f"{name}={quote}{value}{quote}"], [B]
    if kind == 1:
        return [name, rng.choice(["=", ":"]), f"{quote}{value}{quote}"], [O, O, B]
    if kind == 2:
        return [name + ":", f"{quote}{value}{quote}"], [O, B]
    if kind == 3:
        return [rng.choice(["Authorization:", "authorization"]), "Bearer", value], [O, O, B]
    if kind == 4:
        lines = [base64.b64encode(rng.randbytes(48)).decode() for _ in range(rng.randint(3, 6))]
        words = ["-----BEGIN", rng.choice(["RSA", "EC", "OPENSSH"]), "PRIVATE", "KEY-----", *lines, "-----END", "RSA", "PRIVATE", "KEY-----"]
        return words, [B, *[I] * (len(words) - 1)]
    few = "".join(rng.sample(string.ascii_letters + string.digits, rng.choice([3, 6, 12, 62])))
    return [rng.choice(["ghp_", "gho_", "sk_live_", "sk_test_", "glpat-", "npm_", "AIza", "sk-", "xoxp-"]) + draw(rng.randint(20, 48), few)], [B]


def made_decoy(rng: random.Random) -> list[str]:
    """What looks odd and is no secret."""
    n = lambda a, b: rng.randint(a, b)
    return [rng.choice([
        lambda: f"{n(1990, 2030)}-{n(1, 12):02d}-{n(1, 28):02d}", lambda: f"https://www.example.com/{n(1, 99999)}/page?id={n(1, 999)}&ref=abc", lambda: f"v{n(0, 20)}.{n(0, 20)}.{n(0, 99)}", lambda: f"user{n(1, 999)}@mail{n(1, 9)}.example.org",
        lambda: f"{n(1, 255)}.{n(0, 255)}.{n(0, 255)}.{n(1, 254)}", lambda: f"({n(100, 999)})", lambda: f"{n(100, 999)}-{n(1000, 9999)}", lambda: f"{n(10**15, 10**16 - 1)}", lambda: "self.get_value(index)", lambda: f"x_{n(1, 99)}=y[{n(1, 9)}]",
        lambda: f"/usr/local/lib/module{n(1, 9)}/file_{n(1, 99)}.so", lambda: "camelCaseName_withParts", lambda: f"{n(1, 12)}:{n(0, 59):02d}", lambda: f"{n(1, 999)},{n(100, 999)}.{n(10, 99)}", lambda: "e.g.", lambda: "CONSTANT_VALUE_NAME",
        lambda: "token", lambda: "password", lambda: "secret.",
    ])()]


class Tagger:
    """Weights of a trained field, and the scores of the tokens met."""

    def __init__(self, w: np.ndarray, trans: np.ndarray):
        self.w, self.trans = w, trans
        self.lead = crf.margin(trans, O)
        self.clear()

    def __getstate__(self):
        return self.w, self.trans

    def __setstate__(self, state):
        self.__init__(*state)

    def clear(self):
        self.words, self.done = Vocab(), 0
        self.table, self.odd = np.zeros((1 << 12, 9)), np.zeros(1 << 12, dtype=bool)
        self.known: dict[tuple, np.ndarray] = {}

    def scores(self, words: list[bytes]) -> np.ndarray:
        """Emissions: tokens x labels."""
        if len(self.words) > STORE_WORDS:
            self.clear()
        ids = np.fromiter(map(self.words.__getitem__, words), dtype=np.int64, count=len(words))
        if len(self.words) > self.done:
            while len(self.table) < len(self.words):
                self.table, self.odd = np.concatenate([self.table, np.zeros_like(self.table)]), np.concatenate([self.odd, np.zeros_like(self.odd)])
            for word in dict.fromkeys(words):
                if (k := self.words[word]) >= self.done:
                    traits = token_traits(word)
                    key = tuple(traits[0])
                    if (row := self.known.get(key)) is None:
                        row = self.known[key] = np.concatenate([self.w[x].sum(axis=0) for x in traits])
                    self.table[k], self.odd[k] = row, is_odd(word)
            self.done = len(self.words)
        own = self.table[ids]
        e = own[:, 0:3] + self.w[file_traits(len(words), int(self.odd[ids].sum()))].sum(axis=0)
        e[1:] += own[:-1, 3:6]
        e[:-1] += own[1:, 6:9]
        return e

    def spans(self, text: str, words: list[bytes]) -> list[tuple[int, int]]:
        """Code point spans of the secrets tagged, without quotes, brackets and the name assigned to."""
        if not words:
            return []
        tagged = [(s + i, int(y)) for s, labels in crf.viterbi_sparse(self.scores(words), self.trans, O, self.lead) for i, y in enumerate(labels) if y != O]
        if not tagged:
            return []
        place = [m.span() for m in WORD.finditer(text)]
        out: list[list[int]] = []
        last = -2
        for t, y in tagged:
            s, e = place[t]
            if y == I and last == t - 1:
                out[-1][1] = e
            else:
                m = re.fullmatch(r"""["'`(\[{<]*(?:[\w.-]+["']?[=:]+(?=.))?["'`]*(.*?)["'`)\]}>.,;:]*""", text[s:e], re.DOTALL)
                out.append([s + m.start(1), s + m.end(1)] if m and m[1] else [s, e])
            last = t
        return [(s, e) for s, e in out]


def labelled(text: str) -> tuple[list[bytes], list[int]]:
    """Tokens of a text, labelled by the fixed patterns."""
    found = [(s, e) for s, e, _ in patterns(text, text.encode("utf-8", "replace"))]
    words, labels, k = [], [], 0
    for m in WORD.finditer(text):
        while k < len(found) and found[k][1] <= m.start():
            k += 1
        # a match ends in the value, so the token that holds the end is the secret
        hit = k < len(found) and found[k][0] < m.end() and found[k][1] <= m.end() and found[k][1] > m.start()
        words.append(m[0].encode("utf-8", "replace"))
        labels.append(B if hit else O)
    return words, labels


#: Tokens of a stretch that trains, stretches of a text around its odd tokens, and texts that are made up.
SPAN, WINDOWS, INVENTED = 24, 12, 400


def stretches(text: str, windows: int, rng: random.Random) -> list[tuple[list[bytes], list[int], int, int]]:
    """Labelled stretches of a text, each with the whole text's tokens and odd tokens: some that cover what is
    odd or secret in it, and three from anywhere."""
    words, labels = labelled(text)
    odd = list(map(is_odd, words))
    cover: list[int] = []
    for t in range(len(words)):
        if (odd[t] or labels[t] != O) and (not cover or t >= cover[-1] + SPAN // 2 + 6):
            cover.append(max(0, t - SPAN // 2))
    starts = set(rng.sample(cover, min(len(cover), windows))) | {rng.randrange(max(1, len(words) - SPAN)) for _ in range(3)}
    return [(words[s : s + SPAN], labels[s : s + SPAN], len(words), sum(odd)) for s in sorted(starts) if words[s : s + SPAN]]


def train(docs: DataFrame, sample: int = SAMPLE, windows: int = WINDOWS, seed: int = 3) -> Tagger:
    """A field trained on stretches of about ``sample`` documents, with generated secrets and decoys among their words."""
    n = docs.count()
    part = min(1.0, sample / max(n, 1))

    def cut(batches):
        for batch in slices(batches, "text"):
            rows = []
            for text in batch.column("text").to_pylist():
                text = text.encode("utf-8", "replace").decode("utf-8")
                rows += [(b" ".join(words), bytes(labels), all_, odd) for words, labels, all_, odd in stretches(text, windows, random.Random(zlib.crc32(text.encode()) + seed))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.binary(), pa.binary(), pa.int64(), pa.int64()), strict=True)], ["words", "labels", "n_words", "n_odd"])

    chosen = docs.where(F.col("text").isNotNull() & (F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < int(part * (1 << 20)))).select(F.col("text").cast("string"))
    # about sample * (windows + 3) short rows
    rows = chosen.mapInArrow(tidy(cut), "words binary, labels binary, n_words bigint, n_odd bigint").orderBy("words", "labels", "n_words", "n_odd").collect()
    return fit([(bytes(r.words).split(b" "), list(bytes(r.labels)), r.n_words, r.n_odd) for r in rows], windows, seed)


def fit(found: list[tuple[list[bytes], list[int], int, int]], windows: int = WINDOWS, seed: int = 3) -> Tagger:
    """A field from labelled stretches and made-up ones, with generated secrets and decoys set among them."""
    rng, found = random.Random(seed), list(found)
    for _ in range(INVENTED):
        text = " ".join("".join(rng.choice("aeioubcdfglmnprstvw") for _ in range(rng.randint(1, 9))) for _ in range(60)) + "."
        found += stretches(text, windows, rng)
    sequences = []
    for own, y, size, odd in found:
        if rng.random() < 0.6:
            extra, marks = made_secret(rng) if rng.random() < 0.6 else ((d := made_decoy(rng)), [O] * len(d))
            at = rng.randint(0, len(own))
            own, y = own[:at] + [x.encode() for x in extra] + own[at:], y[:at] + marks + y[at:]
        traits, whole = [token_traits(x) for x in own], file_traits(size, odd)
        x = [[*traits[t][0], *whole, *(traits[t - 1][1] if t else ()), *(traits[t + 1][2] if t + 1 < len(own) else ())] for t in range(len(own))]
        sequences.append((x, y))
    return Tagger(*crf.train(sequences, 3))


def fresh(tagger: Tagger) -> Tagger:
    """The tagger with a store of its own, which goes with the task; a broadcast value would keep it."""
    return Tagger(tagger.w, tagger.trans)


def scan_text(tagger: Tagger, raw: bytes) -> list[tuple[int, int, str]]:
    """All spans of a text: those of the fixed patterns, and the field's where they touch none of them."""
    text = raw.decode("utf-8", "replace")
    base = patterns(text, raw)
    more, k, reach = [], 0, 0
    for s, e in tagger.spans(text, raw.split()):  # both lists run by start, so each is passed once
        while k < len(base) and base[k][0] < e:
            k, reach = k + 1, max(reach, base[k][1])
        if reach <= s:
            more.append((s, e, "crf"))
    return sorted(base + more, key=lambda x: (x[0], KINDS.index(x[2])))


def written(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def scan(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every whole text."""
    tagger = train(docs, sample)
    shared = docs.sparkSession.sparkContext.broadcast(tagger)  # a fixed number of weights

    def run(batches):
        own = fresh(shared.value)
        for batch in slices(batches, "text"):
            rows = []
            for raw in binary(batch.column("text")):
                spans = scan_text(own, raw)
                base = [x for x in spans if x[2] != "crf"]
                kinds = [k for _, _, k in base]
                rows.append((kinds.count("assign"), kinds.count("access"), kinds.count("hex"), hashlib.sha256(written(base).encode()).hexdigest(), written(spans)))
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in columns[:3]), *(pa.array(x, pa.string()) for x in columns[3:])], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(tidy(run), "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")


def redact_text(text: str, spans: list[tuple[int, int, str]], mark: str = "[secret]") -> str:
    """``text`` with each stretch that spans cover replaced by ``mark``."""
    out, at = [], 0
    for s, e, _ in spans:
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``docs`` with every secret replaced in text and n_chars set to the new length (both null for null text)."""
    tagger = train(docs, sample)
    shared = docs.sparkSession.sparkContext.broadcast(tagger)
    schema = docs.schema

    def run(batches):
        own = fresh(shared.value)
        for batch in slices(batches, "text"):
            texts = []
            for text in batch.column("text").to_pylist():
                spans = scan_text(own, text.encode("utf-8", "replace")) if text else []
                texts.append(redact_text(text, spans) if spans else text)
            new = pa.array(texts, batch.schema.field("text").type)
            columns = dict(zip(batch.schema.names, batch.columns, strict=True)) | {"text": new}
            if "n_chars" in columns:
                columns["n_chars"] = pa.array([None if t is None else len(t) for t in texts], pa.int64()).cast(columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return docs.mapInArrow(tidy(run), schema)
