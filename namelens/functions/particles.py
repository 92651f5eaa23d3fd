"""Rewriting a name's tokens: joined first parts, patronymic markers, articles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import lexicon as lx
from .text import detect_script, known_name, let, normalize_token, tokenize, without

HYPHENATED = r"(?i)^([aeu])(?:sh|th|[lnrstdz])-"
ASSIMILATED = r"(?i)^[ae]([lnrstdz])\1(?=.{2,}$)"
PLAIN = r"(?i)^[ae]l(?=.{3,}$)"
ARABIC_ARTICLE, HEBREW_ARTICLE = "^ال(?=.{2,}$)", "^אל(?=.{2,}$)"


def strip_article(token: Column, first: Column) -> Column:
    """struct<token, rule>: the token without a definite article and the rule that took it, or null.

    A known name keeps its beginning. Unhyphenated Latin articles go only from tokens that aren't first.
    """
    script = detect_script(token)
    later = ~first
    cases = [
        ((script == "arabic") & token.rlike(ARABIC_ARTICLE), ARABIC_ARTICLE, F.lit("ART-1")),
        ((script == "hebrew") & token.rlike(HEBREW_ARTICLE), HEBREW_ARTICLE, F.lit("ART-1")),
        ((script == "latin") & token.rlike(HYPHENATED), HYPHENATED, F.when(token.rlike("(?i)^[aeu]l-"), "ART-1").otherwise("ART-2")),
        ((script == "latin") & later & token.rlike(ASSIMILATED), r"(?i)^[ae][lnrstdz]", F.lit("ART-2")),
        ((script == "latin") & later & token.rlike(PLAIN), PLAIN, F.lit("ART-1")),
    ]
    out, rule = token, F.lit(None).cast("string")
    for when, pattern, cited in reversed(cases):
        out = F.when(when, F.regexp_replace(token, pattern, "")).otherwise(out)
        rule = F.when(when, cited).otherwise(rule)
    untouched = F.struct(token.alias("token"), F.lit(None).cast("string").alias("rule"))
    return F.when(known_name(token).isNotNull(), untouched).otherwise(F.struct(out.alias("token"), rule.alias("rule")))


def preprocess_tokens(raw: Column) -> Column:
    """struct<tokens, rules>: a name's raw tokens made comparable, and the rules applied in order."""
    marks = F.exists(raw, lambda t: F.when(detect_script(t) == "arabic", t.rlike(lx.ARABIC_MARKS)).when(detect_script(t) == "hebrew", t.rlike(lx.HEBREW_MARKS)).otherwise(t.rlike("[" + "".join(lx.LATIN_FOLD.values()) + "š]")))
    geresh = F.exists(raw, lambda t: (detect_script(t) == "hebrew") & t.rlike(f"['’{lx.GERESH}]"))
    plain = F.filter(F.transform(raw, normalize_token), lambda t: t != "")
    joiner = lambda t: without(t, "-'’").isin(*lx.JOINERS)
    state = F.struct(F.array().cast("array<string>").alias("out"), F.lit(None).cast("string").alias("held"), F.lit(0).alias("joined"))

    def join(acc: Column, t: Column) -> Column:
        paired = F.struct(F.concat(acc.out, F.array(without(F.concat(acc.held, t), "-'’"))).alias("out"), F.lit(None).cast("string").alias("held"), (acc.joined + 1).alias("joined"))
        held = F.struct(acc.out.alias("out"), t.alias("held"), acc.joined.alias("joined"))
        plain_ = F.struct(F.concat(acc.out, F.array(t)).alias("out"), F.lit(None).cast("string").alias("held"), acc.joined.alias("joined"))
        return F.when(acc.held.isNotNull(), paired).when(joiner(t), held).otherwise(plain_)

    folded = F.aggregate(plain, state, join)

    def finish(f: Column) -> Column:
        tokens = F.when(f.held.isNotNull(), F.concat(f.out, F.array(f.held))).otherwise(f.out)
        kept = F.when(F.size(tokens) > 1, F.filter(tokens, lambda t: ~t.isin(*lx.PATRONYMICS))).otherwise(tokens)
        dropped = F.size(tokens) - F.size(kept)
        return let(F.transform(kept, lambda t, i: strip_article(t, i == 0)), lambda parts: F.struct(
            F.filter(F.transform(parts, lambda p: p.token), lambda t: t != "").alias("tokens"),
            F.concat(
                F.when(marks, F.array(F.lit("NORM-1"))).otherwise(F.array().cast("array<string>")),
                F.when(geresh, F.array(F.lit("HEB-1"))).otherwise(F.array().cast("array<string>")),
                F.array_repeat(F.lit("JOIN-1"), f.joined),
                F.array_repeat(F.lit("PAT-1"), dropped),
                F.array_compact(F.transform(parts, lambda p: p.rule)),
            ).alias("rules"),
        ))

    return let(folded, finish)


def name_tokens(name: Column) -> Column:
    return preprocess_tokens(tokenize(name))
