"""Secret scans: fixed patterns, and password guess costs for values in credential contexts.

The base patterns find assignments, access ids and long hexadecimal runs.  The method then rates every
value that stands in a credential context (an assignment of any length, or one of the wider contexts)
by the least number of guesses an attacker needs: a dynamic programme over end positions segments the
value into dictionary words, dates, repeats, keyboard walks and brute-force spans, each with its guess
count, and takes the cheapest product.  Values of at least ``min_log10_guesses`` are added as ``guess``
spans.

The dictionary is that of an attacker who knows common passwords and the language of the texts: the most
common passwords first, then the words of the corpus by frequency (``corpus_words``), counted outside
credential contexts so that a secret on many rows does not become a word.  After a keyword and a mere blank
("bearer", "credentials") a value of plain words is running text and not a credential.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import kept_as, map_batches, map_texts, named, store

MIN_LOG10_GUESSES = 10.0
MARK = "[secret]"
KINDS = ("assign", "access", "hex", "guess")

#: The base patterns, each with the group whose length counts and its least length.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
#: The same assignments up to the value, which ends the match but is not taken, so that a keyword in it is found too.
ASSIGN_HEAD = re.compile(r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?()(?=[A-Za-z0-9+/_.=-])", re.I | re.A)
ASSIGN_VALUE = re.compile(r"[A-Za-z0-9+/_.=-]+")
#: Wider credential contexts up to the value, at the empty group; the value has four characters or more, any number.
CONTEXT_HEAD = re.compile(
    r"(?:pwd|passphrase|passcode|credentials?|private_?key|access_?key|auth_?key|client_?id|bearer)"
    r"[\"']?(\x20*[:=]\x20*|\x20+)[\"']?()(?=[^\s\"'@,;]{4})", re.I | re.A)
URL_HEAD = re.compile(r"://(?=[^\s:/@]+:()[^\s\"'@,;/]{4,}@)", re.A)
#: Words of running text, joined or not, with or without a mark at the end.
PLAIN_WORDS = re.compile(r"(?:[A-Z]?[^\W\d_A-Z]+|[A-Z]+)(?:[-_./'’](?:[A-Z]?[^\W\d_A-Z]+|[A-Z]+))*[-_./!?:)\]]*")
CONTEXT_VALUE = re.compile(r"[^\s\"'@,;]+", re.A)
ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
CONTEXT_WORDS = (b"pwd", b"passphrase", b"passcode", b"credential", b"privatekey", b"private_key", b"accesskey",
                 b"access_key", b"authkey", b"auth_key", b"clientid", b"client_id", b"bearer", b"://")
#: Common passwords and words, most common first; the rank is the guess count.
WORDS = """password qwerty dragon monkey letmein login princess welcome admin master shadow sunshine football
baseball superman batman trustno michael jordan hunter ranger buster soccer hockey killer george charlie andrew
michelle love jessica pepper daniel access joshua maggie starwars silver william dallas yankees hello amanda orange
biteme freedom computer thunder nicole ginger heather hammer summer corvette taylor austin merlin matthew golfer
cheese martin chelsea patrick richard diamond yellow bigdog secret asdf sparky cowboy camaro anthony matrix falcon
bailey guitar jackson purple scooter phoenix aaron default user test guest root changeme example token key pass
the and for with this that from have you not are""".split()
#: Rows of a common keyboard.
KEYBOARD = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
LEET = str.maketrans("4@831!05$7", "aabeiiosst")
DATE = re.compile(r"(?:19|20)\d\d(?:[-/._]?(?:0[1-9]|1[0-2])(?:[-/._]?(?:0[1-9]|[12]\d|3[01]))?)?"
                  r"|(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)\d\d")

#: share of all words from which a word of the corpus is in the dictionary
CORPUS_SHARE = 2e-5
WORD = re.compile(r"(?<![^\W_])[^\W\d_]{3,24}(?![^\W_])")
_KEYWORDS = tuple(w.decode() for w in (*ASSIGN_WORDS, *CONTEXT_WORDS))

_NEXT_TO = {}
for _y, _row in enumerate(KEYBOARD):
    for _x, _c in enumerate(_row):
        _NEXT_TO[_c] = {_r[_x + _d] for _r in KEYBOARD[max(0, _y - 1):_y + 2] for _d in (-1, 0, 1) if 0 <= _x + _d < len(_r)} - {_c}
_SPLIT = math.log10(2)  # each further segment doubles what an attacker must try


def _alphabet(value: str) -> float:
    size = (10 * any(c.isdigit() for c in value) + 26 * any(c.islower() for c in value) + 26 * any(c.isupper() for c in value)
            + 33 * any(not c.isalnum() for c in value))
    return math.log10(max(size, 2))


def segments(value: str, words: Ranks) -> Iterator[tuple[int, int, str, float]]:
    """(start, end, kind, log10 guesses) of every segment that a pattern explains."""
    n, low = len(value), value.lower()
    if len(low) != n:
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
    plain = low.translate(LEET)
    for i in range(n):
        longest = max(words.longest.get(low[i:i + 3], 0), words.longest.get(plain[i:i + 3], 0))
        for j in range(i + 3, min(n, i + longest) + 1):
            rank = words.get(low[i:j]) or words.get(plain[i:j])
            if rank:
                case = 0.0 if value[i:j] == low[i:j] else math.log10(2 if value[i + 1:j].islower() else 2 ** (j - i))
                leet = math.log10(2) * sum(a != b for a, b in zip(low[i:j], plain[i:j])) if low[i:j] not in words else 0.0
                yield i, j, "word", math.log10(rank) + case + leet
        m = DATE.match(value, i)
        if m:
            yield i, m.end(), "date", math.log10(365 * 100 * (4 if m.end() - i > 8 else 1)) if m.end() - i > 4 else 2.0
    for width in (1, 2, 3, 4):  # runs of one repeated unit
        i = 0
        while i + 2 * width <= n:
            j = i + width
            while j < n and value[j] == value[j - width]:
                j += 1
            if j - i >= max(3, 2 * width):
                yield i, j, "repeat", width * 1.5 + math.log10((j - i) / width)
                i = j - width + 1
            else:
                i += 1
    i = 0
    while i < n - 2:  # walks over neighbouring keys, and steps through the alphabet or the digits
        j = i + 1
        while j < n and low[j] in _NEXT_TO.get(low[j - 1], ()):
            j += 1
        if j - i >= 4:
            yield i, j, "walk", math.log10(47 * 8) + 0.4 * (j - i - 1)
            i = j
            continue
        step = ord(low[i + 1]) - ord(low[i])
        j = i + 1
        while step in (1, -1) and j < n and ord(low[j]) - ord(low[j - 1]) == step:
            j += 1
        if j - i >= 3:
            yield i, j, "walk", math.log10(20) + math.log10(j - i)
            i = j - 1
        else:
            i += 1


def log10_guesses(value: str, words: Ranks) -> float:
    """Least log10 guesses over all segmentations (0 for the empty value).

    ``best[j]`` covers the first j characters; a brute-force span costs its length times the value's
    alphabet and is carried along as one running minimum, so the programme is linear in the segments.
    """
    n = len(value)
    if not n:
        return 0.0
    each = _alphabet(value)
    ends: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
    for i, j, _, cost in segments(value, words):
        ends[j].append((i, cost))
    best = [0.0] + [math.inf] * n
    brute = 0.0  # cheapest cover of the first j characters that ends in an open brute-force span
    for j in range(1, n + 1):
        brute += each
        best[j] = min([brute, *(best[i] + cost + (_SPLIT if i else 0.0) for i, cost in ends[j])])
        brute = min(brute, best[j] + _SPLIT)
    return best[n]


class Ranks(dict):
    """Word -> rank; ``longest`` tells how long the words that begin with three letters are at most."""

    def __init__(self, words):
        super().__init__()
        self.longest: dict[str, int] = {}
        for r, w in enumerate(words, 1):
            w = w.lower()
            self.setdefault(w, r)
            self.longest[w[:3]] = max(len(w), self.longest.get(w[:3], 0))


def word_ranks(words=WORDS) -> Ranks:
    return Ranks(words)


def _may_hold_hex(data: bytes) -> bool:
    return b"x" * 24 in data.translate(_HEX_MAP)


_HEX_MAP = bytes(0x78 if c in b"0123456789abcdef" else 0x20 for c in range(256))


def _reaches(value: str, words: Ranks, least: float) -> bool:
    """Whether the value needs ``least`` log10 guesses; one cheap repeat is seen at once."""
    n = len(value)
    if any(n >= max(3, 2 * w) and w * 1.5 + math.log10(n / w) < least and value[w:] == value[:-w] for w in (1, 2, 3, 4)):
        return False
    return log10_guesses(value, words) >= least


def _guess_spans(text: str, starts: list[int], value: re.Pattern, words: Ranks, least: float) -> set[tuple[int, int]]:
    """The values at ``starts`` (ascending) that need ``least`` log10 guesses.

    Values that start within one run end together; what stands in a value that is marked needs no mark of its own.
    """
    found, end, marked = set(), 0, 0
    for a in starts:
        if a >= end:
            end = value.match(text, a).end()
        if end > marked and _reaches(text[a:end], words, least):
            found.add((a, end))
            marked = end
    return found


def _running_text(text: str, at: int) -> bool:
    """Whether the value at ``at`` is made of plain words."""
    words = PLAIN_WORDS.match(text, at)
    return bool(words) and not CONTEXT_VALUE.match(text, words.end())


def find_spans(text: str | None, words: Ranks, least: float = MIN_LOG10_GUESSES) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, end exclusive, by start and then kind as in ``KINDS``."""
    if not text:
        return []
    data = text.encode("utf-8", "surrogatepass")
    low = data.lower()
    spans, guesses = [], set()
    if any(w in low for w in ASSIGN_WORDS):
        spans += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
        guesses |= _guess_spans(text, [m.start(1) for m in ASSIGN_HEAD.finditer(text)], ASSIGN_VALUE, words, least)
    if b"AKIA" in data:
        spans += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    if _may_hold_hex(data):
        spans += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    if any(w in low for w in CONTEXT_WORDS):
        heads = [(m.start(2), m[1].isspace()) for m in CONTEXT_HEAD.finditer(text)] + [(m.start(1), False) for m in URL_HEAD.finditer(text)]
        guesses |= _guess_spans(text, sorted(a for a, loose in heads if not (loose and _running_text(text, a))), CONTEXT_VALUE, words, least)
    spans += [("guess", a, b) for a, b in guesses]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def corpus_words(docs: DataFrame, text_col: str = "text", share: float = CORPUS_SHARE, passwords=WORDS) -> list[str]:
    """``passwords``, then the words of all texts by frequency: those that are at least ``share`` of all
    words (so at most 1 / share of them), of 3 to 24 letters, in lower case.

    Values after a credential keyword, and those in an URL before ``@``, are not counted.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tally: Counter = Counter()
            for text in b.column(0):
                tally.update(_plain_words(text.as_py()))
            yield pa.RecordBatch.from_arrays([pa.array(list(tally), pa.string()), pa.array(list(tally.values()), pa.int64())], names=["word", "n"])
    counts = map_batches(docs.select(named(text_col).cast("string").alias("text")), run, "word string, n bigint")
    counts = store(counts.groupBy("word").agg(F.sum("n").alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    rows = counts.where(F.col("n") >= max(2, math.ceil(share * total))).collect()  # at most 1 / share rows
    return [*passwords, *(r["word"] for r in sorted(rows, key=lambda r: (-r["n"], r["word"])))]


def _plain_words(text: str | None) -> list[str]:
    """Lower-case words of a text outside the values of credential contexts."""
    if not text:
        return []
    low = text.lower()
    if any(w in low for w in _KEYWORDS):
        for head, value in ((ASSIGN_HEAD, ASSIGN_VALUE), (CONTEXT_HEAD, CONTEXT_VALUE), (URL_HEAD, CONTEXT_VALUE)):
            out, end = [], 0
            for m in head.finditer(text):
                a = m.start(m.lastindex)
                if a >= end:
                    out.append(text[end:a])
                    end = value.match(text, a).end()
            text = "".join([*out, text[end:]])
        low = text.lower()
    return WORD.findall(low)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words=WORDS,
         min_log10_guesses: float = MIN_LOG10_GUESSES) -> DataFrame:
    """(id_col, spans): ``spans`` is array<struct<kind, start, end>> over the whole text.

    Null and empty texts have no spans; repeated rows keep a row each; an empty table gives none.  Other
    columns are not read.
    """
    ranks = word_ranks(words)

    def make():
        return lambda text: [dict(zip(("kind", "start", "end"), s)) for s in find_spans(text, ranks, min_log10_guesses)]
    found = map_texts(docs, [id_col], text_col, make, "array<struct<kind:string,start:bigint,end:bigint>>",
                      pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))
    return found.select(*kept_as([id_col]), F.col("result").alias("spans"))


def redact_text(text: str | None, spans: list[tuple[str, int, int]], mark: str = MARK) -> str | None:
    """The text with every span replaced by ``mark``; overlapping spans are replaced as one."""
    if not spans:
        return text
    out, at = [], 0
    for _, start, end in sorted(spans, key=lambda s: s[1:]):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, text_col: str = "text", words=WORDS, min_log10_guesses: float = MIN_LOG10_GUESSES,
           mark: str = MARK) -> DataFrame:
    """``docs`` with the secrets of ``text_col`` replaced; all columns and rows stay."""
    ranks = word_ranks(words)

    def make():
        return lambda text: redact_text(text, find_spans(text, ranks, min_log10_guesses), mark)
    done = map_texts(docs, docs.columns, text_col, make, "string", pa.string())
    return done.select(*[F.col("result").alias(c) if c == text_col else k for c, k in zip(docs.columns, kept_as(docs.columns))])


def spans_text(spans, kinds=KINDS):
    """Column: kind:start:end of the spans of ``kinds``, comma-joined."""
    own = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(own, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
