"""Labels from text and from model answers, as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from annolytics.functions import text

# Classes and sentiment lexicons.
CLASSES = ("negativo", "neutro", "positivo")
POSITIVE_WORDS = (
    "bom boa otimo ótimo otima ótima excelente adorei amei maravilhoso maravilhosa incrivel incrível perfeito perfeita recomendo sensacional show top gostei feliz melhor lindo linda sucesso eficiente satisfeito satisfeita confiavel confiável rapido rápido agradavel agradável"
).split()
NEGATIVE_WORDS = (
    "pessimo péssimo pessima péssima ruim horrivel horrível odeio detestei decepcao decepção lixo pior triste raiva problema reclamacao reclamação cancelei chateado chateada revoltante decepcionante lento lenta arrependimento insatisfeito insatisfeita nojento nojenta"
).split()


def lexicon_counts(t: Column) -> Column:
    words = text.word_array(t)
    count = lambda known: F.size(F.filter(words, lambda w: w.isin(known)))
    return F.struct(count(POSITIVE_WORDS).alias("positive"), count(NEGATIVE_WORDS).alias("negative"))


def lexical_label(t: Column) -> Column:
    """struct(label, confidence): the side with more words and emojis and its share; neutro at 0 without any, at 0.5 in a tie."""
    words, emojis = lexicon_counts(t), text.emoji_sentiment_counts(t)
    p, n = words["positive"] + emojis["positive"], words["negative"] + emojis["negative"]
    label = F.when(p > n, "positivo").when(n > p, "negativo").otherwise("neutro")
    confidence = F.when(p + n == 0, 0.0).when(p == n, 0.5).otherwise(F.greatest(p, n) / (p + n))
    return F.struct(label.alias("label"), confidence.alias("confidence"))


def parse_label_response(raw: Column, *, allowed: tuple[str, ...] = CLASSES) -> Column:
    """struct(label, confidence) of the JSON object in an answer; null without one or with another label.

    Thinking blocks and code fences are ignored; confidence is that of probs for the label, else confidence, else 1, held to 0..1.
    """
    body = F.regexp_extract(F.regexp_replace(raw, "(?s)<think>.*?</think>|```(?:json)?", ""), r"(?s)(\{.*\})", 1)
    value = F.try_parse_json(body)
    label = F.lower(F.trim(F.try_variant_get(value, "$.label", "string")))
    of_label = reduce(lambda w, c: w.when(label == c, F.try_variant_get(value, f"$.probs.{c}", "double")), allowed[1:], F.when(label == allowed[0], F.try_variant_get(value, f"$.probs.{allowed[0]}", "double")))
    confidence = F.coalesce(of_label, F.try_variant_get(value, "$.confidence", "double"), F.lit(1.0))
    return F.when(label.isin(*allowed), F.struct(label.alias("label"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence)).alias("confidence")))


def parse_multi_response(raw: Column, n_items: int, *, allowed: tuple[str, ...] = CLASSES) -> Column:
    """array of n labels from a JSON array of {id, label}; null where an id is missing, repeated, or its label unknown."""
    body = F.regexp_extract(F.regexp_replace(raw, "(?s)<think>.*?</think>|```(?:json)?", ""), r"(?s)(\[.*\])", 1)
    items = F.from_json(body, "array<struct<id:string,label:string>>")

    def of(i: Column) -> Column:
        own = F.filter(items, lambda x: x["id"] == i.cast("string"))
        label = F.lower(F.trim(F.try_element_at(own, F.lit(1))["label"]))
        return F.when((F.size(own) == 1) & label.isin(*allowed), label)

    return F.transform(F.sequence(F.lit(1), F.lit(n_items)), of)


def labeling_prompt(template: str, t: Column) -> Column:
    return F.replace(F.lit(template), F.lit("{{TEXTO}}"), t)


def cache_key(*parts: Column) -> Column:
    """Content address of a completion: SHA-256 of the parts as JSON."""
    return F.sha2(F.to_json(F.struct(*[p.alias(f"p{i}") for i, p in enumerate(parts)])), 256)
