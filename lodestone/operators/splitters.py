"""Text splitters: plain functions over strings, and one way to run them over a table with a row for each chunk."""

from __future__ import annotations

import ast
import posixpath
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate, groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZE, OVERLAP = 832, 32

#: Separators from the coarsest to the finest. Those of Markdown are taken literally.
PLAIN = ["\n\n", "\n", " ", ""]
CHINESE = ["\n\n", "\n", "。|！|？", r"\.\s|\!\s|\?\s", r"；|;\s", r"，|,\s"]
MARKDOWN = ["\n#{1,6} ", "```\n", "\n\\*\\*\\*+\n", "\n---+\n", "\n___+\n", "\n\n", "\n", " ", ""]


# ---------------------------------------------------------------- pieces and packing


def piece_spans(text: str, pattern: str, keep: str | None, begin: int, end: int) -> list[tuple[int, int]]:
    """Spans of text[begin:end] between matches of pattern, which stay with the piece behind (start), before (end) or go."""
    if not pattern:
        return [(i, i + 1) for i in range(begin, end)]
    marks = [m.span() for m in re.compile(pattern).finditer(text, begin, end)]
    opens = [begin, *(a if keep == "start" else b for a, b in marks)]
    closes = [*(b if keep == "end" else a for a, b in marks), end]
    return [(a, b) for a, b in zip(opens, closes, strict=True) if a < b]


def pieces(text: str, pattern: str, keep: str | None = None) -> list[str]:
    """The texts of piece_spans over the whole text."""
    return [text[a:b] for a, b in piece_spans(text, pattern, keep, 0, len(text))]


def packed(parts: Iterable[str], joint: str = "", size: int = SIZE, overlap: int = OVERLAP) -> list[str]:
    """Parts joined greedily up to size characters; each chunk begins with at most overlap characters of parts of the one before.

    Over the running lengths of the parts a chunk's end and the place where the next one begins are two bisections.
    """
    parts = list(parts)
    gap = len(joint)
    upto = [0, *accumulate(len(p) + gap for p in parts)]  # parts a..b take upto[b] - upto[a] - gap characters
    out: list[str] = []
    first = new = 0  # a chunk's first part, and the first one that no chunk has had
    while new < len(parts):
        last = max(new + 1, bisect_right(upto, upto[first] + gap + size) - 1)
        if chunk := joint.join(parts[first:last]).strip():
            out.append(chunk)
        if last < len(parts):
            # As many parts again as overlap allows, and as leave room for the next one.
            least = max(upto[last] - overlap, upto[last + 1] - size) - gap
            first = min(max(first, bisect_left(upto, least)), last)
        new = last
    return out


def by_separator(text: str, separator: str = "\n\n", size: int = SIZE, overlap: int = OVERLAP, regex: bool = False) -> list[str]:
    return packed(pieces(text, separator if regex else re.escape(separator)), separator, size, overlap)


def recursive(text: str, separators: list[str] = PLAIN, size: int = SIZE, overlap: int = OVERLAP, keep: str = "start", regex: bool = False) -> list[str]:
    """Cut at the first separator that occurs; pieces that are still too long are cut by the ones after it.

    A work list of spans of the text: a span with a level is still to be cut from that separator on, a list of spans is a
    run of short neighbours to be packed.
    """
    patterns = [s if regex else re.escape(s) for s in separators]
    out: list[str] = []
    work: list = [((0, len(text)), 0)]
    while work:
        item = work.pop()
        if isinstance(item, list):
            out += packed([text[a:b] for a, b in item], "", size, overlap)
            continue
        (begin, end), level = item
        if level is None:  # too long, and no separator is left
            out.append(text[begin:end])
            continue
        while level < len(patterns) - 1 and patterns[level] and not re.compile(patterns[level]).search(text, begin, end):
            level += 1
        deeper = level + 1 if level + 1 < len(patterns) and patterns[level] else None
        found: list = []
        for long, spans in groupby(piece_spans(text, patterns[level], keep, begin, end), lambda x: x[1] - x[0] >= size):
            found += [(x, deeper) for x in spans] if long else [list(spans)]
        work += reversed(found)
    return out


def chinese(text: str, size: int = SIZE, overlap: int = OVERLAP) -> list[str]:
    """Sentence-wise for Chinese and Latin marks, which stay at the end; runs of newlines become one."""
    return [re.sub("\n{2,}", "\n", c.strip()) for c in recursive(text, CHINESE, size, overlap, "end", True) if c.strip()]


def markdown_by_length(text: str, size: int = SIZE, overlap: int = OVERLAP) -> list[str]:
    return recursive(text, MARKDOWN, size, overlap)


# ---------------------------------------------------------------- markdown headers


def _fenced(lines: Iterable[str]) -> Iterator[tuple[str, bool]]:
    """Lines without what cannot be printed, and whether each belongs to a fenced block (its fences included)."""
    fence = None
    for raw in lines:
        line = "".join(filter(str.isprintable, raw.strip()))
        opened = re.match(r"~~~|```(?!.*```)", line) if fence is None else None
        yield line, bool(fence or opened)
        if opened:
            fence = opened[0]
        elif fence and line.startswith(fence):
            fence = None


def by_header(text: str, levels: int = 3) -> list[tuple[dict[str, str], str]]:
    """(headers, content) of the sections of a Markdown text; headers are "Header 1" and so on. Fenced lines are content."""
    blocks: list[tuple[dict[str, str], list[str]]] = []
    stack: dict[int, str] = {}
    lines: list[str] = []

    def flush():
        nonlocal lines
        if lines:
            heads = {f"Header {n}": stack[n] for n in sorted(stack)}
            if blocks and blocks[-1][0] == heads:
                blocks[-1][1].append("\n".join(lines))
            else:
                blocks.append((heads, ["\n".join(lines)]))
            lines = []

    for line, fenced in _fenced(text.split("\n")):
        m = None if fenced else re.match(r"(#{1,6})(?: |$)", line)
        if m and len(m[1]) <= levels:
            flush()
            n = len(m[1])
            stack = {k: v for k, v in stack.items() if k < n}
            stack[n] = line[n:].strip()
        elif line or fenced:
            lines.append(line)
        else:
            flush()
    flush()
    return [(heads, "  \n".join(parts)) for heads, parts in blocks]


#: Links of images in Markdown and in HTML, and the suffixes of images.
_IMAGES = (re.compile(r"\[[^\]]+\]\(([a-zA-Z0-9:/._~#-]+)\)"), re.compile(r"<img\s+[^>]*?src=[\"']([^\"']*)[\"'][^>]*>"))
_IMAGE_ENDS = (".jpg", ".jpeg", ".png", ".bmp")


def markdown(text: str, path: str = "", size: int = SIZE) -> list[dict]:
    """Text chunks of at least ten characters, lower case behind their headers, and the local images they link to."""
    out: list[dict] = []
    for heads, content in by_header(text):
        lead = " ".join(heads.values())
        for part in markdown_by_length(content, size) if len(content) > size else [content]:
            if len(part) >= 10:
                out.append({"modal": "text", "content": f"{lead} {part.lower()}", **{f"header{n}": heads.get(f"Header {n}") for n in (1, 2, 3)}})
        for link in (x for p in _IMAGES for x in p.findall(content)):
            if link.lower().endswith(_IMAGE_ENDS) and "://" not in link:
                out.append({"modal": "image", "content": posixpath.normpath(posixpath.join(posixpath.dirname(path), link)), **{f"header{n}": heads.get(f"Header {n}") for n in (1, 2, 3)}})
    return out


# ---------------------------------------------------------------- code, pages


def python_code(text: str, name: str) -> list[str]:
    """The file's name, the module's docstring, then "name docstring" of each function and class that has one, level by level."""
    out = [name]
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return out
    if doc := ast.get_docstring(tree):
        out.append(doc)
    for node in ast.walk(tree):
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef) and (doc := ast.get_docstring(node)):
            out.append(f"{node.name} {doc}")
    return out


def graph_pages(text: str, size: int = 2048) -> list[str]:
    """Lines packed up to size; a line of size and more is a page of its own. The place in the list is the page number."""
    out: list[str] = []
    page: list[str] = []
    length = 0
    for line in text.split("\n"):
        if length + len(line) >= size and page:
            out.append("\n".join(page))
            page, length = [], 0
        if len(line) >= size:
            out.append(line)
        else:
            page.append(line)
            length += len(line) + 1
    if any(page):
        out.append("\n".join(page))
    return out


def start_indices(chunks: list[str], text: str, overlap: int = OVERLAP) -> list[int]:
    """Where each chunk begins in text, searched from a little before the end of the one before; -1 if it is not found."""
    out, at = [], 0
    for c in chunks:
        found = text.find(c, max(0, at))
        out.append(found)
        at = (found if found >= 0 else at) + len(c) - overlap
    return out


# ---------------------------------------------------------------- over tables


def split_table(docs: DataFrame, splitter: Callable[[str], list[str]], key: str = "doc_id", overlap: int = OVERLAP) -> DataFrame:
    """key, pos, chunk, start_index for each chunk of docs (key, text). Null texts have no chunk."""

    def run(batches):
        for batch in batches:
            keys, pos, chunks, starts = [], [], [], []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                got = splitter(text) if text else []
                keys += [k] * len(got)
                pos += range(len(got))
                chunks += got
                starts += start_indices(got, text, overlap) if got else []
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(pos, pa.int32()), pa.array(chunks, pa.string()), pa.array(starts, pa.int64())], names=[key, "pos", "chunk", "start_index"])

    return docs.select(F.col(key).cast("long").alias(key), "text").mapInArrow(run, f"{key} long, pos int, chunk string, start_index long")


def split_markdown_table(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, pos, modal, content, header1..3 of Markdown docs (doc_id, path, text)."""
    names = ["modal", "content", "header1", "header2", "header3"]

    def run(batches):
        for batch in batches:
            rows = []
            for k, path, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows += [(k, i, *[c[n] for n in names]) for i, c in enumerate(markdown(text or "", path or "", size))]
            cols = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.int64(), pa.int32(), *[pa.string()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "pos", *names])

    return docs.select(F.col("doc_id").cast("long"), "path", "text").mapInArrow(run, "doc_id long, pos int, modal string, content string, header1 string, header2 string, header3 string")


def prefixed(kind: Column, basename: Column, prefix: Column, text: Column) -> Column:
    """A document's text behind its name: Markdown on a line of its own, others without a separator."""
    return F.when(kind == "md", F.concat(basename, F.lit("\n"), text)).otherwise(F.concat(prefix, text))
