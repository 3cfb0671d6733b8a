"""Record sources: question-answer pairs, JSON lines, concatenated JSON objects, labelled questions, query logs, message JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions.text import without_quotes


def qa_csv(spark: SparkSession, path: str) -> DataFrame:
    """content, qa, modal from a CSV file without header, first column the key, second the value."""
    rows = spark.read.csv(path, header=False, schema="key string, value string", multiLine=True, escape='"')
    return _qa(rows.where("key is not null and value is not null"))


def qa_json(texts: DataFrame) -> DataFrame:
    """The same from JSON texts (column text): an object, or a list of objects with key and value."""
    object_ = texts.where(F.ltrim("text").startswith("{")).select(F.explode(F.from_json("text", "map<string,string>")).alias("key", "value"))
    listed = texts.where(F.ltrim("text").startswith("[")).select(F.inline(F.from_json("text", "array<struct<key:string,value:string>>")))
    return _qa(object_.unionByName(listed).where("key is not null and value is not null"))


def _qa(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("key").alias("content"), F.concat_ws(": ", "key", "value").alias("qa"), F.lit("qa").alias("modal"))


def objects(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON objects printed over several lines one behind the other, each closed by a line with } alone; bad ones are dropped."""
    raw = spark.read.option("lineSep", "\n}").text(path)  # nested braces are indented; what ends the line, CR or not, is white space
    whole = F.concat("value", F.lit("}"))
    return raw.where(F.regexp_replace("value", "\\s", "") != "").select(F.from_json(whole, schema, {"mode": "PERMISSIVE"}).alias("o")).where("o is not null").select("o.*").dropna("all")


def string_list(texts: DataFrame, name: str = "value") -> DataFrame:
    """pos, value of JSON arrays of strings (column text); pos is the number of an entity."""
    return texts.select(F.posexplode(F.from_json("text", "array<string>")).alias("pos", name))


def labelled(spark: SparkSession, good: str, bad: str) -> DataFrame:
    """text, label from one file of good and one of bad questions, one a line; a line keeps its end."""
    read = lambda path, label: spark.read.text(path).select(F.concat("value", F.lit("\n")).alias("text"), F.lit(label).alias("label"))
    return read(good, True).unionByName(read(bad, False))


def query_log(lines: DataFrame) -> DataFrame:
    """file, query_id, text of logs (file, n, line): a line whose first four characters are an id and the fifth a space begins a record, others continue it."""
    line = F.trim("line")
    starts = (F.substring(line, 5, 1) == " ") & F.substring(line, 1, 4).rlike("^[A-Za-z0-9]{4}$")
    rows = lines.select("file", "n", line.alias("line"), starts.alias("starts")).where(F.col("starts") | (F.length("line") >= 5))
    rows = rows.withColumn("record", F.sum(F.col("starts").cast("int")).over(Window.partitionBy("file").orderBy("n"))).where("record > 0")
    text = F.when(F.col("starts"), F.substring("line", 6, 1 << 30)).otherwise(F.col("line"))
    parts = F.sort_array(F.collect_list(F.struct("n", text.alias("t"), F.when(F.col("starts"), F.substring("line", 1, 4)).alias("id"))))
    return rows.groupBy("file", "record").agg(parts.alias("p")).select("file", "record", F.col("p")[0]["id"].alias("query_id"), F.array_join(F.transform("p", lambda x: x["t"]), "\n").alias("text"))


def queries_by_id(log: DataFrame) -> DataFrame:
    """query_id, texts: the distinct texts of each id."""
    return log.groupBy("query_id").agg(F.sort_array(F.collect_set("text")).alias("texts"))


def file_matches(texts: DataFrame, k: int = 1) -> DataFrame:
    """key, path, content of the first k file matches in JSON search results (key, text)."""
    schema = "array<struct<__typename:string,file:struct<path:string,content:string>>>"
    hits = F.slice(F.filter(F.from_json("text", schema), lambda r: r["__typename"] == "FileMatch"), 1, k)
    return texts.select("key", F.inline(hits)).select("key", "file.path", "file.content")


#: Numbers of message types.
MESSAGE_TYPES = {
    "text": ("80001", "60001"),
    "image": ("80002", "60002"),
    "emoji": ("80006",),
    "ref": ("80014", "60014"),
    "link": ("80007", "60007", "90001"),
}
MESSAGE = "struct<messageType:string,wcId:string,data:struct<fromUser:string,fromGroup:string,content:string,title:string,newMsgId:bigint,self:boolean,timestamp:bigint,atlist:array<string>>>"


def chat_messages(raw: DataFrame, bot: str) -> DataFrame:
    """Messages of a group chat from callback JSON (column json): type, query, group_id, user, new_msg_id, ts, skip_reason (null: to be handled)."""
    m = raw.select(F.from_json("json", MESSAGE).alias("m")).select("m.*", "m.data.*").drop("data")
    kind = None
    for name, codes in MESSAGE_TYPES.items():
        hit = F.col("messageType").isin(*codes)
        kind = F.when(hit, name) if kind is None else kind.when(hit, name)
    title = F.when(F.col("content").startswith("<"), F.expr("xpath_string(content, '//title')"))
    body = F.when(kind.isin("ref", "link"), F.coalesce(title, F.col("title"), F.col("content"))).when(kind == "text", F.col("content")).otherwise("")
    query = F.trim(F.regexp_replace(body, "@[^\\s\\u2005]+[\\s\\u2005]", ""))
    at_bot = F.coalesce(F.array_contains("atlist", bot), F.lit(False))
    at_other = F.coalesce(F.size("atlist") > 0, F.lit(False)) & ~at_bot
    reason = (
        F.when(F.col("fromGroup").isNull(), "no group").when(kind.isNull(), "unknown type").when(F.coalesce(F.col("self"), F.lit(False)) | (F.col("fromUser") == bot), "own message")
        .when(at_other, "for others").when((kind == "text") & (query == ""), "empty")
    )
    return m.select(
        F.coalesce(kind, F.lit("unknown")).alias("type"), query.alias("query"), F.col("fromGroup").alias("group_id"), F.concat_ws("|", "fromGroup", "fromUser").alias("user"), F.col("newMsgId").alias("new_msg_id"),
        F.timestamp_seconds("timestamp").alias("ts"), at_bot.alias("at_bot"), reason.alias("skip_reason"),
    )


def closed_issues(issues: DataFrame) -> DataFrame:
    """Issues (html_url, state) that are closed and no pull requests."""
    return issues.where(F.contains("html_url", F.lit("issues")) & (F.col("state") == "closed"))


def issue_markdown(issues: DataFrame, comments: DataFrame) -> DataFrame:
    """name, md: one Markdown text for each issue (number, title, body), its comments (number, seq, text) behind it, quoted lines dropped."""
    said = comments.groupBy("number").agg(F.sort_array(F.collect_list(F.struct("seq", without_quotes(F.col("text")).alias("t")))).alias("said"))
    rows = issues.join(said, "number", "left")
    below = F.coalesce(F.array_join(F.transform("said", lambda s: F.concat(F.lit("\n\n"), s["t"])), ""), F.lit(""))
    return rows.select(F.concat(F.lit("issue-"), F.col("number"), F.lit(".md")).alias("name"), F.concat(F.lit("# "), F.col("title"), F.lit("\n\n"), without_quotes(F.coalesce("body", F.lit(""))), below).alias("md"))


def is_revert(text: Column, commands: tuple[str, ...] = ("xrevert",)) -> Column:
    """Whether a message asks to take replies back: it contains one of the commands, in any case."""
    out = F.lit(False)
    for c in commands:
        out = out | F.contains(F.lower(F.coalesce(text, F.lit(""))), F.lit(c.lower()))
    return out


def mention_kind(mentions: Column, bot: str, message_type: Column) -> Column:
    """NORMAL, AT_BOT, AT_ALL, AT_OTHER, IMAGE or OTHER; mentions is an array of (key, name)."""
    has = lambda name: F.exists(mentions, lambda m: m["name"] == name)
    return (
        F.when(message_type == "image", "IMAGE").when(message_type != "text", "OTHER").when(F.coalesce(F.size(mentions), F.lit(0)) <= 0, "NORMAL")
        .when(has(bot), "AT_BOT").when(F.exists(mentions, lambda m: m["key"] == "@_all"), "AT_ALL").otherwise("AT_OTHER")
    )


def simplified(messages: DataFrame) -> DataFrame:
    """messages (type, text) plus show: normal, ref, image, emoji, app, sys or other; texts of the others become placeholders; at-names go."""
    show = F.when(F.col("type") == "1", "normal").when(F.col("type") == "49-57", "ref").when(F.col("type") == "3", "image").when(F.col("type") == "47", "emoji").when(F.col("type").startswith("49"), "app").when(F.col("type") == "10000", "sys").otherwise("other")
    plain = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "@[^\\s\\u2005]+[\\s\\u2005]", ""))
    return messages.withColumn("show", show).withColumn("text", F.when(F.col("show").isin("normal", "ref"), plain).otherwise(F.concat(F.lit("["), F.col("show"), F.lit("]"))))
