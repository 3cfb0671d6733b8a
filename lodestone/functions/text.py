"""Scalar text functions as column builders (all inside the JVM)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Suffixes by file type, in the order in which they are tested.
SUFFIXES = {
    "pdf": (".pdf",),
    "md": (".md",),
    "ppt": (".pptx",),
    "image": (".jpg", ".jpeg", ".png", ".bmp"),
    "text": (".txt", ".text"),
    "word": (".docx", ".doc"),
    "excel": (".xlsx", ".xls", ".csv"),
    "html": (".html", ".htm", ".shtml", ".xhtml"),
    "code": (".py",),
}


def file_type(path: Column) -> Column:
    """Type by suffix in any case; null if there is none."""
    out = None
    for kind, ends in SUFFIXES.items():
        hit = F.lower(path).rlike("(" + "|".join(e.replace(".", "\\.") for e in ends) + ")$")
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out


def useful_share(text: Column) -> Column:
    """Share of Latin letters, digits and Han characters; null for empty texts."""
    return F.try_divide(F.length(F.regexp_replace(text, "[^a-zA-Z0-9\\u4e00-\\u9fff]", "")).cast("double"), F.length(text).cast("double"))


def is_useful(text: Column, share: float = 0.5) -> Column:
    return F.coalesce(useful_share(text) > share, F.lit(False))


def language(text: Column) -> Column:
    """zh_cn if there are more Han characters than Latin letters, else en."""
    return F.when(F.regexp_count(text, F.lit("[\\u4e00-\\u9fff]")) > F.regexp_count(text, F.lit("[a-zA-Z]")), "zh_cn").otherwise("en")


def normalised_space(text: Column) -> Column:
    """Three rounds of two newlines to one, then three rounds of two spaces to one."""
    for pair, one in (("\n\n", "\n"), ("  ", " ")):
        for _ in range(3):
            text = F.replace(text, F.lit(pair), F.lit(one))
    return text


def clean_markdown(text: Column) -> Column:
    """Lower case; link targets, code fences and long underscores dropped."""
    text = F.regexp_replace(text, "\\[([^\\]]*)\\]\\([^)]*\\)", "$1")
    text = F.regexp_replace(text, "(?s)```.*?```", "")
    return F.lower(F.regexp_replace(text, "_{5,}", ""))


def score_of(text: Column, default: int) -> Column:
    """All digits of an answer, joined, as a number ("8/10" is 810); default if there are none or too many."""
    return F.coalesce(F.regexp_replace(text, "[^0-9]", "").try_cast("bigint"), F.lit(default).cast("bigint"))


def short_hash(content: Column, n: int = 8) -> Column:
    """The first n hexadecimal digits of SHA-256."""
    return F.substring(F.sha2(content, 256), 1, n)


def image_name(uri: Column) -> Column:
    """Six digits of MD5 and the suffix of the address."""
    return F.concat(F.substring(F.md5(uri), 1, 6), F.regexp_extract(uri, "(\\.[A-Za-z0-9]+)$", 1))


def model_bucket(tokens: Column, reserve: int = 2048) -> Column:
    """Smallest context of 8192, 32768, 128000, 256000 that holds the tokens and the reserve; null beyond."""
    need = tokens + reserve
    out = F.when(need <= 8192, 8192)
    for size in (32768, 128000, 256000):
        out = out.when(need <= size, size)
    return out


def remote_token_length(text: Column) -> Column:
    return F.floor(F.length(text) / 2).cast("long")


#: The most characters of a query, by the place that takes it.
QUERY_MOST = {"retrieve": 512, "demo": 400, "web": 32}


def query_guard(text: Column, most: int = 512, least: int = 8) -> Column:
    """What happens to a query: empty, too_short (in groups), truncated, ok."""
    n = F.length(F.coalesce(text, F.lit("")))
    return F.when(n == 0, "empty").when(n < least, "too_short").when(n > most, "truncated").otherwise("ok")


def blocked(value: Column, words: list[str]) -> Column:
    """Whether an intention or topic contains a blocked word; missing counts as undefine."""
    low = F.lower(F.coalesce(value, F.lit("undefine")))
    out = F.lit(False)
    for w in words:
        out = out | F.contains(low, F.lit(w))
    return out


def at_work(ts: Column, start: str, end: str) -> Column:
    """Strictly between two times of day."""
    at = F.date_format(ts, "HH:mm:ss")
    return (at > start) & (at < end)


def suffix4(text: Column) -> Column:
    return F.when(F.length(text) >= 4, F.right(text, F.lit(4)))


def image_kind(base64: Column) -> Column:
    """Kind of a data address of an image: jpeg, png, bmp or INVALID."""
    kind = F.regexp_extract(base64, "^data:image/(jpeg|png|bmp);base64,", 1)
    return F.when(kind == "", "INVALID").otherwise(kind)


def valid_filename(name: Column, most: int = 255) -> Column:
    return F.octet_length(name) <= most


def without_quotes(markdown: Column) -> Column:
    """Quoted lines ("> ...") dropped."""
    return F.regexp_replace(markdown, "(?m)^>.*(\\r?\\n|\\r)?", "")


def without_headers(markdown: Column) -> Column:
    return F.regexp_replace(markdown, "(?m)^#{1,6}\\s*", "")


def cut_query(text: Column, where: str = "retrieve") -> Column:
    """A query cut to what a place takes: retrieval 512 characters, a demo 400, a web search 32."""
    return F.substring(F.coalesce(text, F.lit("")), 1, QUERY_MOST[where])


def within_upload(sizes: Column, most: int = 1000 << 20) -> Column:
    """Whether files of these sizes (a sum) may be uploaded together."""
    return F.coalesce(sizes, F.lit(0)) <= most


def pipeline_code(score: Column, relevant: int = 5, bad: int = 80, unsafe: int = 90) -> Column:
    """The gates of the serial pipeline over one score: relevance below relevant, then security, then a bad answer."""
    return F.when(score < relevant, "UNRELATED").when(score >= unsafe, "SECURITY").when(score >= bad, "BAD_ANSWER").otherwise("SUCCESS")


def json_events(text: Column) -> Column:
    """The strings of an answer's JSON array: plain ones, and those of objects that list them under "events"."""
    items = F.from_json(json_slice(text), "array<string>")
    listed = lambda x: F.from_json(x, "struct<events:array<string>>")["events"]
    return F.coalesce(F.flatten(F.transform(items, lambda x: F.when(x.startswith("{"), F.coalesce(listed(x), F.array().cast("array<string>"))).otherwise(F.array(x)))), F.array().cast("array<string>"))


def json_slice(text: Column) -> Column:
    """The JSON array in an answer: fences dropped, single quotes doubled, cut from the first [ to the last ]."""
    t = F.replace(F.replace(F.replace(text, F.lit("```json"), F.lit("")), F.lit("```"), F.lit("")), F.lit("'"), F.lit('"'))
    return F.regexp_extract(t, "(?s)(\\[.*\\])", 1)


def reference_list(refs: Column) -> Column:
    """Distinct references as a bullet list; empty if there are none."""
    lines = F.array_join(F.transform(F.array_distinct(refs), lambda r: F.concat(F.lit("* "), r)), "\n")
    return F.when(F.size(refs) > 0, F.concat(F.lit("**References:**\n"), lines)).otherwise("")


def reply_text(query: Column, reply: Column, most: int = 30) -> Column:
    """A reply under its query, which is cut."""
    q = F.when(F.length(query) > most, F.concat(F.substring(query, 1, most), F.lit(".."))).otherwise(query)
    return F.concat(q, F.lit("\n---\n"), reply)


def cited_prompt(texts: Column, query: Column, chinese: Column) -> Column:
    """A numbered prompt of passages without their header marks, and the question."""
    parts = F.array_join(F.transform(texts, lambda t, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), without_headers(t))), "\n\n")
    ask = F.when(chinese, F.lit("请依据以上编号的资料回答，并标注引用编号。问题：")).otherwise(F.lit("Answer from the numbered passages above and cite their numbers. Question: "))
    return F.concat(parts, F.lit("\n\n"), ask, query)


def history_pairs_kept(history: Column) -> Column:
    """History pairs (user, bot) without rejected, null or empty sides."""
    bad = lambda s: F.coalesce(F.length(s), F.lit(0)) == 0
    return F.filter(history, lambda h: ~(bad(h["user"]) | bad(h["bot"]) | F.coalesce(F.contains(h["bot"], F.lit("<reject>")), F.lit(False))))


def months_apart(a: Column, b: Column) -> Column:
    return F.abs(F.months_between(F.trunc(a, "month"), F.trunc(b, "month"))).cast("int")
