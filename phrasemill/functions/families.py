"""Lexical and structural families of a phrase, as higher-order array functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import as_column

#: Words that make no family.
STOP_WORDS = (
    "about after before from into near that the this with "
    "без был была были быть для его или как над она они под при про так что это этот этого эти этих"
).split()
#: Question words that make a structure worth a look.
ANCHORS = "как где куда откуда почему зачем сколько что кто чей how where which what why when who".split()
#: Families that stand for documents.
DOCUMENTS = (
    "заявл* анкет* резюм* справ* догов* образ* бланк* форма* докум* шабло* "
    "appli* resum* form templ* contr* certi* docum*"
).split()
#: Families of intent vocabulary, looked at first.
DISCOVERY = [
    *(
        "отзыв* обзор* мнени* опыт плюс* минус* досто* недос* сравн* отлич* выбор* выбир* инстр* руков* причи* ошибк* "
        "неисп* ремон* замен* устан* сняти* схема* разме* харак* описа* соста* расхо* ресур* прове* рейти* надеж* пробл* "
        "жалоб* форум* видео* фото тест "
        "купит* куплю* цена стоим* заказ* прода* магаз* доста* налич* аренд* услуг* прайс* скидк* акция* запис* "
        "revie* opini* exper* pros cons compa* guide* manua* specs* speci* repla* repai* insta* error* probl* ratin* "
        "price* cost order* sale shop deliv* rent"
    ).split(),
    *DOCUMENTS,
]
#: Lexical families clear enough to decide.
DECISIVE = (
    "отзыв* обзор* мнени* плюс* минус* досто* недос* сравн* отлич* инстр* причи* ошибк* неисп* схема* харак* описа* "
    "жалоб* рейти* купит* куплю* цена стоим* revie* opini* pros cons guide* manua* specs* price* cost order*"
).split()
PREFIX = 5
#: Tokens of a phrase that structures are taken from.
BOUND = 12
#: Tokens between two significant ones at most.
REACH = 3


def is_anchor(token: Column) -> Column:
    return token.startswith("как") | token.isin(ANCHORS)


def family_key(token: Column | str) -> Column:
    """The first five letters and `*`, a four-letter token itself, or null for short, stop and number tokens. Tokens are normalised."""
    token = as_column(token)
    none = (F.char_length(token) < 4) | token.isin(STOP_WORDS) | ~token.rlike("[a-zа-я]")
    return F.when(none, None).when(F.char_length(token) >= PREFIX, F.concat(F.substring(token, 1, PREFIX), F.lit("*"))).otherwise(token)


def families(normalized: Column | str) -> Column:
    """The distinct families of a normalised phrase, sorted.

    Lexical: the key of each token. Structural, over the first 12 tokens: neighbours (unless both are stop words), successive
    significant tokens at most three apart, and neighbouring triples with a question word.
    """
    tokens = F.filter(F.split(as_column(normalized), " "), lambda t: t != "")
    keyed_once = F.transform(tokens, lambda t, i: F.struct(i.alias("i"), t.alias("t"), family_key(t).alias("l"), t.isin(STOP_WORDS).alias("s"), is_anchor(t).alias("q")))
    items = F.transform(keyed_once, lambda x: F.struct(x["i"].alias("i"), x["l"].alias("l"), F.coalesce(x["l"], F.when(x["q"], x["t"])).alias("k"), x["s"].alias("s"), x["q"].alias("q")))
    return let(items, lambda x: F.array_sort(F.array_distinct(F.concat(_lexical(x), let(F.slice(x, 1, BOUND), _structural)))))


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once: in an expression tree each mention would be another evaluation."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _lexical(items: Column) -> Column:
    return F.filter(F.transform(items, lambda x: x["l"]), lambda k: k.isNotNull())


def _following(items: Column, by: int) -> Column:
    """Each item with the one `by` further on."""
    n = F.greatest(F.size(items) - by, F.lit(0))
    return F.zip_with(F.slice(items, 1, n), F.slice(items, by + 1, n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def _structural(items: Column) -> Column:
    keyed = lambda p: p["a"]["k"].isNotNull() & p["b"]["k"].isNotNull()
    joined = lambda pairs, keep: F.transform(F.filter(pairs, keep), lambda p: F.concat_ws(" ", p["a"]["k"], p["b"]["k"]))

    def neighbours(pairs: Column) -> Column:
        two = joined(pairs, lambda p: keyed(p) & ~(p["a"]["s"] & p["b"]["s"]))
        asked = lambda x: x["a"]["a"]["q"] | x["a"]["b"]["q"] | x["b"]["b"]["q"]
        three = F.filter(_following(pairs, 1), lambda x: keyed(x["a"]) & x["b"]["b"]["k"].isNotNull() & asked(x))
        return F.concat(two, F.transform(three, lambda x: F.concat_ws(" ", x["a"]["a"]["k"], x["a"]["b"]["k"], x["b"]["b"]["k"])))

    significant = F.filter(items, lambda x: x["k"].isNotNull())
    bridged = let(significant, lambda x: joined(_following(x, 1), lambda p: p["b"]["i"] - p["a"]["i"] <= REACH))
    return F.concat(let(_following(items, 1), neighbours), bridged)


def is_structure(family: Column) -> Column:
    return family.contains(" ")


def is_prioritised(family: Column) -> Column:
    """Whether a question word is in the family."""
    return F.exists(F.split(family, " "), lambda t: is_anchor(F.rtrim(t, F.lit("*"))))


def is_document(family: Column) -> Column:
    return F.exists(F.split(family, " "), lambda t: t.isin(DOCUMENTS))
