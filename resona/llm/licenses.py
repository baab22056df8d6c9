"""License scans by conditional compression.

Lines that speak of licences or copyright are candidates, with the words around
them as far as a notice may reach.  Templates whose words stand there in their
order, with few differences, mark candidate blocks.  A block is compressed alone
and with each template as a zstandard raw dictionary; templates rank by the size
they save, and the first whose exact wording differences confirm it wins the
words it covers.  What is left of the block is ranked again, so notices side by
side are all found, and wrapped lines and comment marks do not matter.  Candidate
lines without a notice come out with their best-ranked template, unconfirmed.

Wording confirms a template if few of its words are lost, none that tells it from
another licence's template or names a version, and if the words added neither
deny it nor are those that another licence's template has more.
"""

from __future__ import annotations

import bisect
import difflib
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .license_texts import TEMPLATES

#: Words of a notice's vicinity: a region has these.
TRIGGER = r"(?i)licen[cs]e|copyright|\(c\)|©|permission (is|to)|hereby granted|redistribut|public domain|spdx|warrant(y|ies)|creative commons|CC0|CC BY"
#: Share of a template's words that may be lost at most.
DIFFERENT = 0.2
#: Templates that each have at least this share of their words in the other are siblings, told apart by the rest.
SIBLING = 0.5
#: Words of a template that is one line.
LINE = 16
#: Added words, or words just before, that deny a notice.
DENIALS = frozenset("not never no nor neither without cannot isn't aren't wasn't don't doesn't".split())
#: Words that are looked at together; longer regions go piece by piece, overlapping by the longest reach.
PIECE = 2048
#: Longest block, in characters, whose verdict is remembered, and how many are.
REMEMBERED = 512
#: What an aligned word gains over a word in between that is not the template's.
GAIN = 10
#: Where a line break and a comment mark may stand between two words.
_WRAPPED = re.compile(TRIGGER.replace(" ", r"[\W_]+"))
_WORD = re.compile(r"[^\W_]+(?:[.'][^\W_]+)*", re.U)


class Template(NamedTuple):
    name: str
    number: int  # among the licence's templates
    words: tuple[str, ...]
    bag: Counter
    need: int  # words of it that a notice keeps at least
    telling: Counter  # words that tell it from its siblings
    others: tuple[frozenset[str], ...]  # what each sibling has more
    with_dictionary: zstandard.ZstdCompressor


class Verdict(NamedTuple):
    license: str
    saving: float
    runner_up: str
    words_lost: int
    words_added: int
    changes: str
    confirmed: bool


def _plain(text: str) -> str:
    return " ".join(text.lower().split())


def _words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


@lru_cache(1)
def templates() -> tuple[Template, ...]:
    texts = [(name, i, text, _words(text)) for name, found in TEMPLATES.items() for i, text in enumerate(found)]
    out = []
    for name, i, text, words in texts:
        bag = Counter(words)
        telling = Counter({w: n for w, n in bag.items() if any(map(str.isdigit, w))})
        others = []
        for sibling, _, _, theirs in texts:
            lost, more = bag - Counter(theirs), Counter(theirs) - bag
            if sibling != name and sum(lost.values()) <= SIBLING * len(words) and sum(more.values()) <= SIBLING * len(theirs):
                telling |= lost
                others.append(frozenset(theirs) - frozenset(words))
        raw = zstandard.ZstdCompressionDict(_plain(text).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        compressor = zstandard.ZstdCompressor(level=19, dict_data=raw, write_content_size=False)
        out.append(Template(name, i, tuple(words), bag, len(words) - int(DIFFERENT * len(words)), telling, tuple(o for o in others if o), compressor))
    return tuple(out)


@lru_cache(1)
def _alone() -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=19, write_content_size=False)


def rank(block: str) -> list[tuple[float, Template]]:
    """(share of the compressed size saved, template) of each template, best first."""
    raw = _plain(block).encode()
    alone = len(_alone().compress(raw))
    return sorted((((alone - len(t.with_dictionary.compress(raw))) / alone, t) for t in templates()), key=lambda x: (-x[0], x[1].name, x[1].number))


def differences(block: Sequence[str], template: Template) -> tuple[Counter, Counter, str]:
    """The template's words that the block lacks, the words it has more, and the changes spelled out in order."""
    lost, added, said = [], [], []
    for kind, i, j, k, m in difflib.SequenceMatcher(None, template.words, block, autojunk=False).get_opcodes():
        if kind != "equal":
            lost += template.words[i:j]
            added += block[k:m]
            said.append(f"-{' '.join(template.words[i:j])}" * (j > i) + f"+{' '.join(block[k:m])}" * (m > k))
    return Counter(lost), Counter(added), "; ".join(said)


def confirms(template: Template, lost: Counter, added: Counter, before: Sequence[str] = ()) -> bool:
    """Whether the exact differences, and the words just before, leave no doubt that the template is meant."""
    if sum(lost.values()) > DIFFERENT * len(template.words) or DENIALS & (set(added) | set(before)):
        return False
    told = template.telling & lost
    if sum(told.values()) > DIFFERENT * sum(template.telling.values()) or any(any(map(str.isdigit, w)) for w in told):
        return False
    # a word of a sibling settles a line; longer texts share words by chance
    return not any(len(more & set(added)) > (len(more) // 2 if len(template.words) > LINE else 0) for more in template.others)


def _reach(n: int) -> int:
    """Most words between the first and the last of a notice after a template of n words."""
    return 2 * n + 8 if n < 64 else n + n // 2 + 40


@lru_cache(1)
def vicinity() -> int:
    """Words around a trigger that a notice may take: the most from any template's word to a trigger, and as many again."""
    far = 0
    for found in TEMPLATES.values():
        for text in found:
            spots = [m.start() for m in _WORD.finditer(text)]
            hits = [bisect.bisect_right(spots, m.start()) - 1 for m in _WRAPPED.finditer(text)]
            far = max(far, max(min(abs(i - h) for h in hits) for i in range(len(spots))))
    return 2 * far + 8


def regions(text: str) -> list[tuple[int, int]]:
    """(first character, end) of the triggers with the words around them; those that meet are one."""
    hits = [m.span() for m in _WRAPPED.finditer(text)]
    if not hits:
        return []
    spans = [m.span() for m in _WORD.finditer(text)]
    starts = [a for a, _ in spans]
    out: list[tuple[int, int]] = []
    for a, b in hits:
        if spans:
            i, j = max(0, bisect.bisect_right(starts, a) - 1 - vicinity()), min(len(spans) - 1, bisect.bisect_left(starts, b) + vicinity())
            a, b = min(a, starts[i]), max(b, spans[j][1])
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _dense(words: Sequence[str], template: Template) -> Iterator[int]:
    """Where a window of the template's reach begins that holds as many of its words as a notice needs."""
    wants, size = template.bag, _reach(len(template.words))
    held: Counter[str] = Counter()
    n = 0
    for end in range(len(words) + size - 1):
        if end < len(words) and (w := words[end]) in wants:
            n += held[w] < wants[w]
            held[w] += 1
        if end >= size and (w := words[end - size]) in wants:
            held[w] -= 1
            n -= held[w] < wants[w]
        if n >= template.need:
            yield max(0, end - size + 1)


def _align(words: Sequence[str], template: Template) -> tuple[int, int] | None:
    """(first word, end) of the first alignment that keeps enough words, at its best end."""
    n = len(template.words)
    none = (0, 0, 0)  # gain, first word, words kept
    before = [none] * (n + 1)
    best = first = None
    for j, w in enumerate(words):
        now = [none]
        for i, t in enumerate(template.words):
            gain, at, kept = before[i + 1]
            top = max(now[i], (gain - 1, at, kept) if gain > 1 else none)
            if t == w:
                gain, at, kept = before[i]
                top = max(top, (gain + GAIN, at, kept + 1) if gain else (GAIN, j, 1))
            now.append(top)
        before = now
        gain, at, kept = now[n]
        if kept >= template.need and (first is None or at <= first) and (best is None or gain > best[0]):
            first = j if first is None else first
            best = (gain, at, j + 1)
        if first is not None and j > first + n:
            break
    return best and best[1:]


def aligned(words: Sequence[str]) -> list[tuple[int, int, Template]]:
    """(first word, end, template) wherever a template's words stand in their order."""
    bag = Counter(words)
    found = []
    for template in templates():
        if sum(min(n, bag[w]) for w, n in template.bag.items()) < template.need:
            continue
        reach, done = _reach(len(template.words)), 0
        for at in _dense(words, template):
            at = max(at, done)
            while hit := _align(words[at : at + 2 * reach], template):
                found.append((at + hit[0], at + hit[1], template))
                at = done = at + hit[1]
            done = max(done, at + reach)
    return sorted(found, key=lambda x: x[:2])


def _verdict(ranked: list[tuple[float, Template]], template: Template, lost: Counter, added: Counter, said: str, sure: bool) -> Verdict:
    saved = next(s for s, t in ranked if t is template)
    other = next((t.name for _, t in ranked if t.name != template.name), "")
    return Verdict(template.name, saved, other, sum(lost.values()), sum(added.values()), said, sure)


def _before(text: str, at: int) -> list[str]:
    """The last words before a place, in the same sentence."""
    return _words(re.split(r"[.;:!?]\s|\n\s*\n", text[max(0, at - 60) : at])[-1])[-3:]


def _winners(text: str, spans: list[tuple[int, int]], found: list[tuple[int, int, Template]]) -> Iterator[tuple[int, int, Verdict]]:
    """The notices of one candidate block: overlapping alignments, judged in the order of their saving."""
    while found:
        a, b = min(x for x, _, _ in found), max(y for _, y, _ in found)
        block = text[spans[a][0] : spans[b - 1][1]]
        ranked = rank(block)
        place = {id(t): i for i, (_, t) in enumerate(ranked)}
        for x, y, template in sorted(found, key=lambda f: (place[id(f[2])], f[0])):
            lost, added, said = differences([text[p:q].lower() for p, q in spans[x:y]], template)
            if confirms(template, lost, added, _before(text, spans[x][0])):
                yield spans[x][0], spans[y - 1][1], _verdict(ranked, template, lost, added, said, True)
                found = [f for f in found if f[1] <= x or f[0] >= y]
                break
        else:
            return


def _judge(block: str) -> Verdict:
    """A block without a notice: its best-ranked template, unconfirmed."""
    return _judged(block) if len(block) <= REMEMBERED else _judged.__wrapped__(block)


@lru_cache(1 << 14)
def _judged(block: str) -> Verdict:
    ranked = rank(block)
    template = ranked[0][1]
    return _verdict(ranked, template, *differences(_words(block), template), False)


def notices(text: str) -> list[tuple[int, int, Verdict]]:
    """(first character, end, verdict) of each notice, and of each piece of a candidate line without one."""
    found: list[tuple[int, int, Verdict]] = []
    near = regions(text)
    overlap = max(_reach(len(t.words)) for t in templates())
    for a, b in near:
        every = [m.span() for m in _WORD.finditer(text, a, b)]
        for at in range(0, len(every), PIECE):
            # a notice belongs to the piece that it begins in, unless one of the piece before covers it
            edge = max((n[1] for n in found[-1:]), default=0)
            stop = every[at + PIECE][0] if at + PIECE < len(every) else b
            spans = every[at : at + PIECE + overlap]
            left = aligned([text[x:y].lower() for x, y in spans])
            mine = []
            while left:  # alignments that meet are one block
                block, end = [left[0]], left[0][1]
                while len(block) < len(left) and left[len(block)][0] < end:
                    block.append(left[len(block)])
                    end = max(end, block[-1][1])
                left = left[len(block) :]
                mine += [n for n in _winners(text, spans, block) if edge <= n[0] < stop]
            found += sorted(mine, key=lambda n: n[:2])
    return sorted([*found, *_without(text, near, [n[:2] for n in found])], key=lambda n: n[:2])


def _without(text: str, near: list[tuple[int, int]], taken: list[tuple[int, int]]) -> Iterator[tuple[int, int, Verdict]]:
    """Lines with a trigger that no notice touches, neighbours together, as far as the words around their triggers go."""
    ends = [y for _, y in taken]
    parts: list[tuple[int, int]] = []
    for at, b in near:
        while at < b:
            stop = text.find("\n", at, b)
            stop = b if stop < 0 else stop
            k = bisect.bisect_right(ends, at)
            if (k == len(taken) or taken[k][0] >= stop) and _WRAPPED.search(text, at, stop):
                if parts and parts[-1][1] + 1 >= at:
                    parts[-1] = (parts[-1][0], stop)
                else:
                    parts.append((at, stop))
            at = stop + 1
    for start, end in parts:
        spans = [m.span() for m in _WORD.finditer(text, start, end)]
        for i in range(0, max(1, len(spans)), PIECE):
            x, y = spans[i][0] if i else start, spans[i + PIECE - 1][1] if i + PIECE < len(spans) else end
            yield x, y, _judge(text[x:y])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        row: list[int] = []
        out: list[list] = [[] for _ in range(10)]
        for i, text in enumerate(batch.column("text").to_pylist()):
            for n, (start, end, verdict) in enumerate(notices(text or "")):
                row.append(i)
                for into, v in zip(out, (n, start, end, *verdict), strict=True):
                    into.append(v)
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.bool_()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(pa.array(row, pa.int64())), *[pa.array(v, k) for v, k in zip(out, kinds, strict=True)]],
            ["doc_id", "block", "start", "end", *Verdict._fields],
        )


def scan(docs: DataFrame) -> DataFrame:
    """A row for each notice and each candidate block without one: where it stands, its licence and how sure that is.

    doc_id, block (from 0), start and end (characters), license, saving (share
    of the compressed size), runner_up, words_lost, words_added, changes,
    confirmed.  Texts without candidates, empty and null ones give no rows; very
    long ones go piece by piece; rows that repeat give theirs each; ties in saving
    go to the template first by name; an empty table gives no rows; other columns
    are ignored, whatever their names.
    """
    slim = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(
        _scan,
        f"doc_id {kind}, block int, start long, end long, license string, saving double, runner_up string, words_lost int, words_added int, changes string, confirmed boolean",
    )
