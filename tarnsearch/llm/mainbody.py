"""Problem 2: main text of a page against its surroundings.

A page is read as a tree: page, sections, blocks, lines.  A block is a run of lines of one shape, either
paragraphs (with the lists and code behind them) or labels - short lines without a sentence; blank lines and
surroundings end it.  A section is a block of labels and the paragraphs it leads to.  Every paragraph has points
for its length and its commas, less its link density, and passes them to its block, half of them to its
section and a quarter to the page.

* Link density is the share of a line that is the page's link texts, titles of linked addresses, or items of a
  row ("a | b | c", "a > b").  Words of surroundings (lines.py: cookie notices, share requests, legal lines) are a
  prior: they count like links.
* Of the paragraphs, the best block is kept and every sibling with points of its own that is not mostly links, or
  near the best in points.
* Labels have no points.  They live on half of what their section's paragraphs have (at most ``support``) and
  lose that to link density, to a place in a list of short items or of titles, and to being a word or two; a label
  that says the page's title, an author or a date gains.  Labels that lead to nothing have nothing.

So a menu, a list of other articles or a footer falls because no paragraph stands below it, whatever its words.

A null text gives no lines; an empty list of links counts as none; a page without paragraphs keeps the labels
that are neither linked nor surroundings by their words.  Rows are handled one by one, so repeated rows give
repeated results; blank lines are numbered and never reported.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnsearch.llm.lines import SURROUNDINGS, Kinds, clean

_WORDS = re.compile(r"\w+")
_SLUG = re.compile(r"[^a-z0-9]+")
_TAIL = re.compile(r"/([^/?#]+)/?(?:[?#].*)?$")
_PLAIN = str.maketrans("àáâäèéêëìíîïòóôöùúûüñç", "aaaaeeeeiiiioooouuuunc")
_ROW = re.compile(r"\s*[|/·•]\s+|\s+[/·•]\s*|\s{2,}|\t")
_TRAIL = re.compile(r"\s[>»›]\s")
_BULLET = re.compile(r"^[-–•*+·»>]\s+")


def _slug(text: str) -> str:
    return _SLUG.sub("-", text.lower().translate(_PLAIN)).strip("-")


def row_of_items(raw: str) -> bool:
    """Short items side by side: a menu or a breadcrumb by its form."""
    raw = raw.strip()
    if raw[-1:] in ".!?":
        return False
    items = [x for x in _ROW.split(raw) if x]
    return len(items) > 2 and raw.count(" ") + 1 <= 4 * len(items) + 3 or len(_TRAIL.split(raw)) > 1 and all(x.count(" ") < 4 for x in _TRAIL.split(raw))


class PageTree:
    """Scores one page after another.

    ``paragraph`` is the number of words from which an unpunctuated line counts as one, ``near`` the share of the best
    block's points that makes a block its sibling, ``linked`` the density from which a line is mostly links, ``support``
    the most a section gives its labels, ``prior`` how much words of surroundings count (0: the tree alone).
    """

    def __init__(self, paragraph: int = 14, near: float = 0.2, linked: float = 0.8, support: float = 2.0, prior: float = 1.0):
        self.kinds, self.paragraph, self.near, self.linked, self.support, self.prior = Kinds(), paragraph, near, linked, support, prior

    def surroundings(self, text: str, title: str | None, link_texts: list[str], hrefs: list[str]) -> list[int]:
        """Numbers of the non-blank lines that are not main text."""
        raw = text.split("\n")
        lines = [clean(x) for x in raw]
        kinds = [self.kinds(x) if x else "" for x in lines]
        head = clean(title or "").lower()
        density = self._densities(raw, lines, kinds, head, link_texts, hrefs)
        para = self._paragraphs(lines, kinds, density)
        points = [(1 + lines[i].count(",") + min(3.0, len(lines[i]) / 100) if kinds[i] == "sentence" or lines[i].count(" ") + 1 >= self.paragraph else 0.3) * (1 - density[i]) if para[i] else 0.0 for i in range(len(lines))]
        blocks = self._blocks(lines, para, density)
        total = [sum(points[i] for i in b) for b in blocks]
        solid = [n for n, b in enumerate(blocks) if para[b[0]]]
        # points of the block and half of those of the rest of its section
        section = self._sections(blocks, para)
        by_section: dict[int, float] = {}
        for n, s in enumerate(section):
            by_section[s] = by_section.get(s, 0.0) + total[n]
        score = [total[n] + (by_section[section[n]] - total[n]) / 2 for n in range(len(blocks))]
        best = max((score[n] for n in solid), default=0.0)
        kept: set[int] = set()
        for n in solid:
            links = sum(len(lines[i]) * density[i] for i in blocks[n]) / sum(len(lines[i]) for i in blocks[n])
            if total[n] > 0 and links < self.linked or score[n] >= self.near * best > 0:
                kept.update(blocks[n])
        if not kept and solid:  # all of it links
            kept.update(blocks[max(solid, key=lambda n: sum(len(lines[i]) for i in blocks[n]))])
        below = 0.0
        first = solid[0] if solid else len(blocks)
        for n in range(len(blocks) - 1, -1, -1):
            b = blocks[n]
            if para[b[0]]:
                below = total[n] if kept.issuperset(b) else 0.0
            else:
                support = min(self.support, below / 2) if solid else self.support / 2
                kept.update(self._labels(b, lines, kinds, density, head, support, n < first))
                if any(density[i] < self.linked for i in b):  # what stands above leads to these labels
                    below = 0.0
        return [i for i, k in enumerate(kinds) if k and i not in kept]

    def _densities(self, raw, lines, kinds, head, link_texts, hrefs) -> list[float]:
        """How far each line is links, a row of items, or surroundings by its words; the page's title is none of them."""
        linked = {clean(t).lower() for t in link_texts if t} - {head, ""}
        phrases = _phrases(linked)
        tails = None
        out = [0.0] * len(lines)
        for i, (line, k) in enumerate(zip(lines, kinds)):
            low = line.lower()
            if not k or low == head:
                continue
            if k in SURROUNDINGS and self.prior:
                out[i] = self.prior
                continue
            if low in linked or _BULLET.sub("", low) in linked or row_of_items(raw[i]):
                out[i] = 1.0
                continue
            if phrases:
                out[i] = _covered(_WORDS.findall(low), phrases)
            if hrefs and out[i] < 1 and 3 <= line.count(" ") + 1 <= 14:
                if tails is None:
                    tails = [m[1].lower() for m in map(_TAIL.search, hrefs) if m]
                if _addressed(_slug(line), tails) and not (k == "short" and i + 1 < len(lines) and kinds[i + 1] == "sentence"):
                    out[i] = 1.0
        return out

    def _paragraphs(self, lines, kinds, density) -> list[bool]:
        """Sentences and long lines, and the lists, entries and code below them."""
        out, before = [False] * len(lines), False
        for i, k in enumerate(kinds):
            if not k:
                continue
            surrounding = k in SURROUNDINGS and density[i] >= self.linked
            out[i] = not surrounding and (k == "sentence" or lines[i].count(" ") + 1 >= self.paragraph and density[i] < self.linked or k == "code" or k == "list" and before and lines[i].count(" ") > 1)
            before = out[i] or before and surrounding
        return out

    def _blocks(self, lines, para, density) -> list[list[int]]:
        blocks: list[list[int]] = []
        last = None
        for i, line in enumerate(lines):
            shape = (para[i], para[i] and density[i] >= self.linked) if line else None
            if shape is not None:
                if shape != last:
                    blocks.append([])
                blocks[-1].append(i)
            last = shape
        return blocks

    @staticmethod
    def _sections(blocks, para) -> list[int]:
        out, n, before = [], 0, True
        for b in blocks:
            n += not para[b[0]]
            out.append(n)
        return out

    def _points_on(self, kind, words, own, top) -> bool:
        """Whether a label announces the titles below it ("most read")."""
        return kind == "pointer" if self.prior and kind in SURROUNDINGS else not top and not own and words <= 4

    def _labels(self, block, lines, kinds, density, head, support, top) -> list[int]:
        """The labels of a block that their section's paragraphs carry."""
        words = [lines[i].count(" ") + 1 for i in block]
        own = [2.0 if lines[i].lower() == head and head else 1.5 if kinds[i] in ("byline", "date") else 0.0 for i in block]
        plain = [n for n, i in enumerate(block) if not own[n] and density[i] < self.linked and words[n] > 2]
        menu = sum(w <= 3 and not o for w, o in zip(words, own)) > 2
        kept = []
        for n, i in enumerate(block):
            worth = support + own[n] - 2.5 * density[i]
            if not own[n]:
                worth -= 2.0 * (words[n] <= 2) + 2.0 * (menu and words[n] <= 3)
                # of several titles at most the last heads the paragraphs; titles below a label of few words are its own
                if n in plain and (not top and len(plain) > 1 and (plain[-1] != n or len(plain) > 2) or n and self._points_on(kinds[block[n - 1]], words[n - 1], own[n - 1], top)):
                    worth -= 2.0
            if worth > 0 and (support > 0 or own[n]):
                kept.append(i)
        return kept


def _phrases(texts: set[str]) -> dict[str, list[list[str]]]:
    """The words of link texts, by their first word and the longest first."""
    found: dict[str, list[list[str]]] = {}
    for words in sorted(map(_WORDS.findall, texts), key=len, reverse=True):
        if words:
            found.setdefault(words[0], []).append(words)
    return found


def _covered(words: list[str], phrases: dict[str, list[list[str]]]) -> float:
    """Share of a line's words that are link texts."""
    if phrases.keys().isdisjoint(words):
        return 0.0
    i = hits = 0
    while i < len(words):
        n = next((len(p) for p in phrases.get(words[i], ()) if words[i : i + len(p)] == p), 0)
        hits += n
        i += n or 1
    return hits / len(words)


def _addressed(slug: str, tails: list[str]) -> bool:
    """Whether a title's slug is the last part of a linked address."""
    return len(slug) > 12 and any(t.startswith(slug[:30]) or len(t) > 16 and slug.startswith(re.sub(r"-\d+$", "", t)) for t in tails)


def _finder(keep: bool):
    def run(batches):
        tree = PageTree()
        for b in batches:
            ids, numbers, bodies = [], [], []
            for i, title, text, texts, hrefs in zip(*(c.to_pylist() for c in b.columns)):
                if text is None:
                    continue
                bad = tree.surroundings(text, title, texts or [], hrefs or [])
                if keep:
                    gone = set(bad)
                    ids.append(i)
                    bodies.append("\n".join(x for n, x in enumerate(text.split("\n")) if n not in gone))
                else:
                    ids += [i] * len(bad)
                    numbers += bad
            last = pa.array(bodies, pa.string()) if keep else pa.array(numbers, pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), last], names=["rec_id", "main_text" if keep else "line_no"])

    return run


def _input(pages: DataFrame, id_col: str, title_col: str, text_col: str, links_col: str | None) -> DataFrame:
    texts = hrefs = F.array().cast("array<string>")
    if links_col:
        if "struct" in dict(pages.dtypes)[links_col]:
            texts, hrefs = F.col(f"{links_col}.text"), F.col(f"{links_col}.href")
        else:
            hrefs = F.col(links_col)
    return pages.select(F.col(id_col).cast("long").alias("i"), F.col(title_col).alias("t"), F.col(text_col).alias("x"), texts.alias("lt"), hrefs.alias("lh")).where("i is not null and x is not null")


def surrounding_lines(pages: DataFrame, id_col: str, title_col="title", text_col="text", links_col="links") -> DataFrame:
    """(rec_id, line_no): the lines outside the main text."""
    return _input(pages, id_col, title_col, text_col, links_col).mapInArrow(_finder(False), "rec_id long, line_no int")


def main_texts(pages: DataFrame, id_col: str, title_col="title", text_col="text", links_col="links") -> DataFrame:
    """(rec_id, main_text): every non-null text with its main lines only; a text that is all surroundings becomes empty."""
    return _input(pages, id_col, title_col, text_col, links_col).mapInArrow(_finder(True), "rec_id long, main_text string")
