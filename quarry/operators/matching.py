"""Answer matching beyond a hit list: every passage of a corpus that contains an answer.

C5 corpus-wide form for the ``dpr_string`` match type (answer tokens occur
contiguously among the passage tokens), by positional postings:

1. the corpus is read once: its pairs of neighbouring tokens with their places, (token,
   next, id, position), are cut to the pairs that some answer has where they are made,
   before any shuffle, and stored; for answers of one token also that token's places (next: "");
2. each answer starts from its pair with the fewest postings: every place of it
   proposes a start (place less the pair's place in the answer);
3. the answer's other pairs are looked up at start + their place, by (id, position,
   pair); a start where all are found is an occurrence.

The answers' tables are stored first, so Spark knows their bytes: it broadcasts them
below its threshold and shuffles above (a hot pair's join is then split by AQE). Only
the postings of proposed places are compared, never the passages' texts.

An answer without tokens matches every passage (reference semantics): it comes back
once, with a null id, instead of with every passage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import nfd, word_tokens
from quarry.session import ensure_parallelism, stored


def answer_tokens(answers: DataFrame, *, a_id: str = "aid", answer: str = "answer") -> DataFrame:
    return answers.select(F.col(a_id).alias("aid"), word_tokens(nfd(F.col(answer))).alias("atoks"))


def empty_answers(answers: DataFrame, *, a_id: str = "aid", answer: str = "answer") -> DataFrame:
    """Answers with no tokens: they match every passage."""
    return answer_tokens(answers, a_id=a_id, answer=answer).where(F.size("atoks") == 0).select("aid")


def postings(passages: DataFrame, tokens: DataFrame, *, p_id: str = "id", text: str = "text") -> DataFrame:
    """(tok, id, pos): the places of the given tokens (tok) in the passages; no passage is shuffled for it."""
    return _places(passages, p_id, text).join(tokens, "tok", "left_semi").select("tok", "id", "pos")


def pair_postings(passages: DataFrame, pairs: DataFrame, *, p_id: str = "id", text: str = "text") -> DataFrame:
    """(tok, nxt, id, pos): the places of the given pairs (tok, nxt; distinct) in the passages; a pair
    with an empty nxt has all places of its token. No passage is shuffled for it."""
    places = _places(passages, p_id, text).join(pairs.select("tok").distinct(), "tok", "left_semi")
    places = places.withColumn("nxt", F.get("_toks", F.col("pos") + 1)).drop("_toks")
    single = pairs.where(F.col("nxt") == "").select("tok", F.lit("").alias("_single"))
    double = pairs.where(F.col("nxt") != "").select("tok", "nxt", F.col("nxt").alias("_double"))
    marked = places.join(single, "tok", "left").join(double, ["tok", "nxt"], "left")
    found = F.filter(F.array("_single", "_double"), lambda x: x.isNotNull())
    return marked.where(F.col("_single").isNotNull() | F.col("_double").isNotNull()).select("tok", F.explode(found).alias("nxt"), "id", "pos")


def _places(passages: DataFrame, p_id: str, text: str) -> DataFrame:
    """(id, _toks, pos, tok) of every token. The tokens are a column of their own, which the generated code explodes; the
    outer form keeps Spark from filtering by their number, for which it would make them twice."""
    toks = ensure_parallelism(passages).select(F.col(p_id).alias("id"), word_tokens(nfd(F.col(text))).alias("_toks"))
    return toks.select("id", "_toks", F.posexplode_outer("_toks").alias("pos", "tok")).where(F.col("tok").isNotNull())


def answer_occurrences(answers: DataFrame, passages: DataFrame, *, a_id: str = "aid", answer: str = "answer",
                       p_id: str = "id", text: str = "text") -> DataFrame:
    """(aid, id) for every answer and every passage containing it (dpr_string); (aid, null) for
    an answer without tokens, which every passage contains. Jobs run here: four tables are
    stored. The key ``a_id`` may be a struct; passage ids are unique."""
    atoks = stored(answer_tokens(answers, a_id=a_id, answer=answer), "answer-tokens")
    tok, nxt = F.col("_pair.tok"), F.col("_pair.nxt")
    parts = atoks.select("aid", F.posexplode(_pairs("atoks")).alias("at", "_pair")).select("aid", "at", tok, nxt)
    posts = stored(pair_postings(passages, stored(parts.select("tok", "nxt").distinct(), "pairs"), p_id=p_id, text=text), "postings")
    counts = posts.groupBy("tok", "nxt").agg(F.count(F.lit(1)).alias("n"))
    # An answer with a pair that no passage has is out here: its pair has no count.
    counted = parts.join(counts, ["tok", "nxt"], "left")
    rarest = counted.groupBy("aid").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "at", "tok", "nxt")).alias("m"))
    rarest = stored(rarest.where(F.col("m.n") > 0).select("aid", F.col("m.at").alias("at"), F.col("m.tok").alias("tok"), F.col("m.nxt").alias("nxt")), "rarest")
    starts = posts.join(rarest, ["tok", "nxt"]).where(F.col("pos") >= F.col("at")).select("aid", "id", (F.col("pos") - F.col("at")).alias("start"), "at")
    proposed = starts.join(atoks, "aid")
    # A passage without an id is found by one token alone.
    alone = proposed.where((F.size("atoks") == 1) | ((F.size("atoks") == 2) & F.col("id").isNotNull())).select("aid", "id")
    others = (proposed.where(F.size("atoks") > 2)
              .select("aid", "id", "start", F.col("at").alias("own"), (F.size("atoks") - 2).alias("wanted"), F.posexplode(_pairs("atoks")).alias("at", "_pair"))
              .where(F.col("at") != F.col("own"))
              .select("aid", "id", "start", "wanted", tok, nxt, (F.col("start") + F.col("at")).alias("pos")))
    found = (others.join(posts, ["id", "pos", "tok", "nxt"], "left_semi").groupBy("aid", "id", "start", "wanted")
             .agg(F.countDistinct("pos").alias("n")).where(F.col("n") == F.col("wanted")).select("aid", "id"))
    every = atoks.where(F.size("atoks") == 0).select("aid", F.lit(None).cast(passages.schema[p_id].dataType).alias("id"))
    return alone.unionByName(found).distinct().unionByName(every).select(F.col("aid").alias(a_id), F.col("id").alias(p_id))


def _pairs(tokens: str) -> Column:
    """array<struct<tok, nxt>>: every token but the last with its next one; a lone token with an empty next."""
    first = F.slice(tokens, 1, F.greatest(F.size(tokens) - 1, F.lit(1)))
    return F.transform(first, lambda t, i: F.struct(t.alias("tok"), F.coalesce(F.get(tokens, i + 1), F.lit("")).alias("nxt")))
