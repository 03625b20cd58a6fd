"""Text quality statistics of each document, to tell natural prose from lists, tables and junk.

A text is taken block by block (blank lines part blocks). Three signals of a block's layout are measured over its lines:
- vertical delimiter alignment: delimiters are entered into a histogram of the columns they stand in, counted in
  characters for runs of blanks (their two edges, and the line's end) and in fields for tabs, bars, leaders and the
  like; the signal is the share of lines with a delimiter in a column that most lines share,
- indentation periodicity: each line's indent and kind of mark form a sequence; the signal is the best agreement of the
  sequence with itself, moved by one to four lines,
- line-length autocorrelation: the highest value at lags of one to four lines of the sequence of line lengths.
Each alone makes a block a table or a list if the block's ratios of letters, symbols and sentence ends allow it. What is
neither is read as running text: lines are joined, cut into sentences, and a sentence counts as natural language if its
words, symbols and punctuation are those of language: it ends, has words, mostly letters, and a share of common words of
one of ten languages. A section is prose by the share of its non-blank characters in such sentences.

Null texts give null statistics and no finding but that of char_len, which needs a text to be compared with. Empty and
blank texts have zero counts and null ratios. Very long texts are read whole. Repeated rows give one row each in the
statistics, one finding in all. Extra columns are ignored. Empty tables give empty results.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.langid import ANCHORS

LEAST_CHARS = 200
PROSE_SHARE = 0.5

COMMON = frozenset(w for words in ANCHORS.values() for w in words.split())
_WORD = re.compile(r"[^\W_]+")
_LETTERS = re.compile(r"[^\W\d_]+")
_KANA = re.compile(r"[ぁ-ん]")
_LEAD = re.compile(r"[ \t]*(?:[•*‣◦–-](?=\s)|\([^\W_]{1,4}\)|[^\W_]{1,4}[.)](?=\s)|\d{1,3}(?:\.\d{1,3})*\.?(?=\s))\s*[|–-]?\s*")
_END = re.compile(r"[.!?…][\"'”’)\]»]*(?=\s|$)|[。！？]")
_EDGE = ".,;:!?()[]\"'“”’»«"
_CLOSING = "\"'”’)]»"
_ABBREVIATED = re.compile(r"(?:^|[\s(])(?:no|nos|nr|vol|art|sec|fig|[^\W\d_])$", re.I)
#: Delimiters whose columns are counted in fields.
_FIELDS = (re.compile(r"\t"), re.compile(r"\|"), re.compile(r"\.{4,}"), re.compile(r" [·/»>] "), re.compile(r",(?=\S)"), re.compile(r"<[^<>]*>"))
_GAP = re.compile(r"(?<=\S)(?: {2,}|\t+ *)(?=\S)")
_MARK_KINDS = (("bullet", re.compile(r"[•*‣◦–-]")), ("bracket", re.compile(r"\([^\W_]{1,4}\)")), ("number", re.compile(r"\d")), ("letter", re.compile(r"[^\W_]")))
#: A column counts where so many of a block's lines have a delimiter in it; lags of both sequences end at LAGS.
SHARED, LAGS = 0.6, 4


def column_alignment(lines: list[str]) -> float:
    """Share of lines with a gap whose edge, or the line's end behind it, stands in a character column that SHARED of all
    lines have an edge in."""
    edges = []
    for x in lines:
        held = {e for m in _GAP.finditer(x) for e in m.span()}
        edges.append(held | {len(x)} if held else held)
    columns = Counter(e for held in edges for e in held)
    shared = {c for c, n in columns.items() if n >= SHARED * len(lines)}
    return sum(1 for held in edges if held & shared) / len(lines) if shared else 0.0


def field_alignment(lines: list[str]) -> float:
    """Share of lines that reach the columns most lines reach, for the best delimiter counted in fields; lines that hold the
    delimiter, but reach other columns, count for nine tenths."""
    best = 0.0
    for d in _FIELDS:
        reach = Counter(n for n in (len(d.findall(x)) for x in lines) if n)
        if reach:
            n, k = reach.most_common(1)[0]
            best = max(best, k / len(lines), 0.9 * sum(reach.values()) / len(lines) if n > 1 or len(reach) > 1 else 0.0)
    return best


def alignment(lines: list[str]) -> float:
    return max(column_alignment(lines), field_alignment(lines)) if lines else 0.0


def _mark(lead: re.Match | None) -> str:
    """The kind of mark a line begins with."""
    said = lead.group(0).lstrip() if lead else ""
    return next((kind for kind, pattern in _MARK_KINDS if pattern.match(said)), "") if said else ""


def periodicity(lines: list[str]) -> tuple[float, float]:
    """(of marked lines, of indents): share of lines that begin as the line one to LAGS before them does; for marked lines
    with a mark, for indents with any indent, where those of one period differ."""
    starts = [(len(x) - len(x.lstrip()), _mark(_LEAD.match(x))) for x in lines]
    n, marked, indented = len(lines), 0.0, 0.0
    for lag in range(1, min(LAGS, max(1, n // 3)) + 1):
        met = [b for a, b in zip(starts, starts[lag:]) if a == b]
        k = sum(1 for _, mark in met if mark)
        marked = max(marked, (k + lag) / n if k else 0.0)
        if lag > 1 and met and len(set(starts[:lag])) > 1 and any(i for i, _ in met):
            indented = max(indented, (len(met) + lag) / n)
    return min(1.0, marked), min(1.0, indented)


def autocorrelation(sizes: list[int], lags: int = LAGS) -> float:
    """The highest autocorrelation of the lengths of consecutive lines at lags of one to `lags`, a third of the lines at most;
    1 where all are the same, 0 under three lines."""
    n = len(sizes)
    if n < 3:
        return 0.0
    mean = sum(sizes) / n
    off = [s - mean for s in sizes]
    spread = sum(d * d for d in off)
    if spread < 1e-9:
        return 1.0
    return max(sum(a * b for a, b in zip(off, off[k:])) / spread for k in range(1, min(lags, n // 3) + 1))


def block_kind(lines: list[str]) -> str:
    """'table', 'list' or 'text'."""
    n = len(lines)
    ended = sum([x[-1] in ".!?…。！？" or x[-1] in _CLOSING and x[-2:-1] in ".!?…" for x in lines]) / n
    solid = sum(len(x) - x.count(" ") for x in lines)
    letters = sum(map(len, _LETTERS.findall(" ".join(lines))))
    if letters < 0.5 * solid:
        return "table"
    if n < 2:
        return "text"
    marked, indented = periodicity(lines)
    if marked >= 0.7 and ended < 0.4:
        return "list"
    sizes = [len(x) for x in lines]
    if n < 3 or ended >= 0.2:
        return "text"
    if column_alignment(lines) >= 0.75 or max(sizes) < 130 and letters < 0.7 * solid and field_alignment(lines) >= 0.75:
        return "table"
    # from here on no line may hold the end of a sentence
    if max(sizes) < 130 and not any(_END.search(x) for x in lines):
        if indented >= 0.9 or n >= 6 and autocorrelation(sizes) >= 0.5:
            return "list"
        if sorted(sizes)[n // 2] < 28:  # label lines
            return "list"
    return "text"


def natural(sentence: str) -> bool:
    """Whether a piece of text that ends like a sentence is one."""
    words = _LETTERS.findall(sentence.lower())
    letters = sum(map(len, words))
    if 2 * letters < len(sentence) - sentence.count(" "):
        return False
    if not sentence.isascii() and (kana := len(_KANA.findall(sentence))) >= 3:
        return kana >= 0.15 * letters
    n = len(words)
    return n >= 4 and letters <= 14 * n and sum(map(COMMON.__contains__, words)) >= max(1, 0.06 * n)


def foreign_line(line: str) -> bool:
    """Whether a line of some length can't be part of a sentence: half symbols and figures, or hardly a small word and no
    common one of two letters or more."""
    solid = len(line) - line.count(" ")
    if solid < 30 or not line.isascii() and _KANA.search(line):
        return False
    if 2 * sum(map(len, _LETTERS.findall(line))) < solid:
        return True
    words = line.lower().split()
    if any(len(w) > 1 and w.strip(_EDGE) in COMMON for w in words):
        return False
    return not line.isupper() and 2 * sum(1 for w in line.split() if w[0].islower() and w.strip(_EDGE).isalpha()) < len(words)


def runs_on(line: str, after: str) -> bool:
    """Whether a sentence may go on from a line to the one after it: that goes on small, or the line was full."""
    head = after.lstrip()[:1]
    return not (head.isupper() or head.isdigit()) or len(line) + 1 + len(after.split(None, 1)[0]) >= 0.7 * len(after)


def prose_chars(lines: list[str]) -> int:
    """Non-blank characters of the natural sentences of a block of running text."""
    parts: list[tuple[str, bool]] = []  # text, whether it ends like a sentence
    held = ""
    marked = [_LEAD.match(x) for x in lines]
    for k, line in enumerate(lines):
        lead = marked[k]
        listed = lead is not None and (line.lstrip()[:1] in "•*‣◦–-(" or k > 0 and marked[k - 1] is not None or k + 1 < len(lines) and marked[k + 1] is not None)
        foreign = len(lines) > 1 and foreign_line(line)
        if held and (listed or foreign or not runs_on(lines[k - 1], line)):
            parts.append((held, False))
            held = ""
        if foreign:
            parts.append((line, False))
            continue
        at = 0
        for m in _END.finditer(line, lead.end() if lead else 0):
            if m.end() < len(line) and _ABBREVIATED.search(line[max(0, m.start() - 6) : m.start()]):
                continue
            parts.append((held + line[at : m.end()], True))
            held, at = "", m.end()
        held += line[at:] + " "
        if not held.strip():
            held = ""
    if held:
        parts.append((held, False))
    total, after = 0, False
    for text, ended in parts:
        good = ended and (natural(text) or after and len(text) < 40)
        if good:
            total += len("".join(text.split()))
        after = good
    return total


FIELDS = (
    ("n_chars", pa.int64(), "long"), ("n_solid", pa.int64(), "long"), ("n_words", pa.int64(), "long"), ("n_lines", pa.int64(), "long"),
    ("mean_word", pa.float64(), "double"), ("symbol_ratio", pa.float64(), "double"), ("ended_lines", pa.float64(), "double"),
    ("common_words", pa.float64(), "double"), ("aligned", pa.float64(), "double"), ("indent_period", pa.float64(), "double"),
    ("length_autocorrelation", pa.float64(), "double"), ("table_share", pa.float64(), "double"), ("list_share", pa.float64(), "double"), ("prose_share", pa.float64(), "double"),
)


def blocks(text: str) -> list[list[str]]:
    """The lines of each block, without outer blanks and carriage returns on the right."""
    out: list[list[str]] = [[]]
    for line in text.split("\n"):
        line = line.rstrip()
        if line:
            out[-1].append(line)
        elif out[-1]:
            out.append([])
    return [b for b in out if b]


def shares(text: str) -> tuple[int, int, int, int]:
    """Non-blank characters: all, those in tables, in lists, and in natural sentences."""
    solid = len("".join(text.split()))
    table = listed = prose = 0
    for lines in blocks(text):
        kind = block_kind(lines)
        if kind == "text":
            prose += prose_chars(lines)
        else:
            n = sum(len("".join(x.split())) for x in lines)
            table, listed = (table + n, listed) if kind == "table" else (table, listed + n)
    return solid, table, listed, prose


def statistics_of(text: str) -> tuple:
    """The values of FIELDS for one text."""
    words = _WORD.findall(text)
    lines = [x for b in blocks(text) for x in b]
    solid, table, listed, prose = shares(text)
    if not solid:
        return (len(text), 0, 0, 0, *[None] * 10)
    n = len(words)
    return (
        len(text), solid, n, len(lines), sum(map(len, words)) / n if n else None, (solid - sum(map(len, words))) / solid,
        sum(1 for x in lines if x[-1] in ".!?。！？:;") / len(lines), sum(1 for w in words if w.lower() in COMMON) / n if n else None,
        alignment(lines), max(periodicity(lines)), autocorrelation([len(x) for x in lines]), table / solid, listed / solid, prose / solid,
    )


def statistics(sections: DataFrame, key: str = "section_id") -> DataFrame:
    """(key, FIELDS): the statistics of every text; no shuffle."""

    def scan(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows = [statistics_of(t) if t is not None else (None,) * len(FIELDS) for t in batch.column(1).to_pylist()]
            columns = list(zip(*rows)) if rows else [()] * len(FIELDS)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, t) for c, (_, t, _) in zip(columns, FIELDS))], names=[key, *(f[0] for f in FIELDS)]
            )

    kind = sections.schema[key].dataType.simpleString()
    return sections.select(key, "text").mapInArrow(scan, f"{key} {kind}, " + ", ".join(f"{n} {t}" for n, _, t in FIELDS))


def findings(sections: DataFrame, least_chars: int = LEAST_CHARS, prose_share: float = PROSE_SHARE) -> DataFrame:
    """(section_id, finding): not_prose and char_len, each once per section."""

    def scan(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            ids, kinds = [], []
            for key, claimed, text in zip(*(c.to_pylist() for c in batch.columns)):
                if claimed is not None and claimed != len(text):
                    ids.append(key)
                    kinds.append("char_len")
                if len(text) >= least_chars:
                    solid, _, _, prose = shares(text)
                    if solid and prose < prose_share * solid:
                        ids.append(key)
                        kinds.append("not_prose")
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(kinds, pa.string())], names=["section_id", "finding"])

    own = sections.filter(F.col("section_id").isNotNull() & F.col("text").isNotNull()).select("section_id", F.col("char_len").cast("long"), "text")
    return own.mapInArrow(scan, "section_id string, finding string").distinct()
