"""Prompts of the pipeline's model calls, in English and Chinese, as column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: {0} is the first argument, {1} the second.
TEMPLATES = {
    "intention": ("Name the user's intention and the topic of this message as JSON with the keys intention and topic.\nMessage: {0}", "请判断下面消息的意图和主题，以 JSON 返回 intention 和 topic 两个键。\n消息：{0}"),
    "relevance": ("How well does the material answer the question? Reply with a number from 0 to 10.\nQuestion: {0}\nMaterial: {1}", "材料在多大程度上回答了问题？请给出 0 到 10 的分数。\n问题：{0}\n材料：{1}"),
    "keywords": ("List the search words for this question, separated by commas.\nQuestion: {0}", "请列出这个问题的搜索关键词，用逗号分隔。\n问题：{0}"),
    "perplexity": ("Does the reply leave the question open? 0 is answered, 10 is open.\nQuestion: {0}\nReply: {1}", "回复是否没有解决问题？0 表示已解决，10 表示没有。\n问题：{0}\n回复：{1}"),
    "security": ("Rate from 0 to 10 how unsafe it is to publish this text.\nText: {0}", "请从 0 到 10 评价公开这段文字的风险。\n文字：{0}"),
    "generate": ("Answer from the material alone.\nMaterial:\n{0}\nQuestion: {1}", "请只根据材料回答。\n材料：\n{0}\n问题：{1}"),
    "cr_need": ("Does this message refer to something said before that it does not name? Answer yes or no.\nBefore:\n{0}\nMessage: {1}", "这条消息是否指代了前文但没有写明？请回答是或否。\n前文：\n{0}\n消息：{1}"),
    "rewrite": ("Rewrite the message so that it stands alone.\nBefore:\n{0}\nMessage: {1}", "请改写消息，使其不依赖前文。\n前文：\n{0}\n消息：{1}"),
}


def prompt(name: str, chinese: Column, first: Column, second: Column | None = None) -> Column:
    """The named prompt in the language of the call, its arguments put in (missing ones as nothing)."""
    args = [F.coalesce(x, F.lit("")) for x in (first, second if second is not None else F.lit(""))]

    def filled(template: str) -> Column:
        parts = []
        for n, piece in enumerate(template.replace("{1}", "{0}\0").split("{0}")):
            if n:
                parts.append(args[1] if piece.startswith("\0") else args[0])
            parts.append(F.lit(piece.removeprefix("\0")))
        return F.concat(*parts)

    english, other = TEMPLATES[name]
    return F.when(chinese, filled(other)).otherwise(filled(english))
