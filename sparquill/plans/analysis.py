"""Queries of language analysis: stemmers by rule tables, normalisation, bigrams, character maps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import stems
from .registry import TEXT, Tables, query

_WORDS = f"with {TEXT}, w as (select distinct lower(term) as term from df)"
#: Words of scripts that the documents lack, one a row, so that their rules are seen at work.
_SAMPLE = "لڑکیاں والكتاب المدرسة ساهدهات كتابها ﷼ لِلعِلم آباء إيمان یک کتاب ۀ लड़कियों जाएंगी किताबें बच्चा पढ़ाकर 東京都に行く ＡＢＣ１２３ 한국어 テスト 中".split()
_TABLE = ", ".join(f"('{w}')" for w in _SAMPLE)


def _words(t: Tables) -> DataFrame:
    return t.index.vocabulary().select(F.lower("term").alias("term")).distinct()


def _sample(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([(w,) for w in _SAMPLE], "term string")


def _register(name: str, stemmer: stems.Stemmer) -> None:
    foreign = name in ("hindi", "arabic")
    rows = f"with w as (select * from (values {_TABLE}) as v(term))" if foreign else _WORDS

    def run(t: Tables) -> DataFrame:
        return (_sample(t) if foreign else _words(t)).select("term", stemmer.column(F.col("term")).alias("stem"))

    query(f"{rows} select term, {stemmer.sql('term')} as stem from w", f"stems_{name}")(run)


for _name, _stemmer in stems.STEMMERS.items():
    _register(_name, _stemmer)

_FROM = f"from (values {_TABLE}) as v(term)"


@query(f"select term, translate(term, '{stems._ARABIC[0]}', '{stems._ARABIC[1]}') as arabic, translate(term, '{stems._PERSIAN[0]}', '{stems._PERSIAN[1]}') as persian {_FROM}")
def normalized_letters(t: Tables) -> DataFrame:
    one = F.array("term")
    return _sample(t).select("term", F.get(stems.normalize_arabic(one), F.lit(0)).alias("arabic"), F.get(stems.normalize_persian(one), F.lit(0)).alias("persian"))


@query(f"select term, list_aggregate(list_transform(string_split(term, ''), lambda c: case when ord(c) between 65281 and 65374 then chr(ord(c) - 65248) else c end), 'string_agg', '') as folded {_FROM}")
def folded_width(t: Tables) -> DataFrame:
    return _sample(t).select("term", F.get(stems.fold_width(F.array("term")), F.lit(0)).alias("folded"))


_CJK = "[\\p{Han}\\p{Hiragana}\\p{Katakana}\\p{Hangul}]"


@query(f"with r as (select term, unnest(regexp_extract_all(term, '{_CJK}+')) as run {_FROM}) select term, unnest(case when length(run) = 1 then [run] else list_transform(range(1, length(run)), lambda i: substr(run, i, 2)) end) as token from r")
def cjk_bigrams(t: Tables) -> DataFrame:
    rows = _sample(t).select("term", F.explode(stems.cjk_bigrams(F.col("term"))).alias("token"))
    return rows.filter(F.col("token").rlike(r"^[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]"))


@query("select doc_id, md5(replace(replace(replace(coalesce(text, ''), 'the', 'X'), 'and', '&'), 'of', '')) as mapped from documents")
def mapped_characters(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(stems.map_chars(F.coalesce("text", F.lit("")), {"the": "X", "and": "&", "of": ""}).cast("binary")).alias("mapped"))


@query(f"with {TEXT} select term, replace(format('{{:.3f}}', df / n), ',', '') as share, cast((df + 6) // 7 as bigint) as sevenths from df cross join st")
def formatted_shares(t: Tables) -> DataFrame:
    n = t.index.stats().select("n").scalar()
    return t.index.vocabulary().select("term", F.format_string("%.3f", F.col("df") / n).alias("share"), F.expr("(df + 6) div 7").alias("sevenths"))
