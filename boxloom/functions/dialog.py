"""Prompts in our own words, dialogs, and the hooks that models plug into."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .text import PHASE1_HEADER, PHASE2_HEADER

DESCRIBE_PROMPT = "Describe everything visible in this picture in one exact paragraph, objects with their colours, materials and places first."
PHASE1_SYSTEM = f"You list visible things named in captions. Use only given words. Begin with \"{PHASE1_HEADER}\" and number the items."
PHASE2_SYSTEM = f"You refine lists of things. Give bare nouns only. Begin with \"{PHASE2_HEADER}\" and number the items."
#: Bytes of one Arrow batch handed to a model, at most (a longer row is a batch of its own); they bound a worker's memory.
BATCH_BYTES = 4 << 20


def phase1_query(web: Column, vlm: Column) -> Column:
    return F.concat(F.lit("Noisy caption: "), web, F.lit("\nDetailed caption: "), vlm, F.lit("\nList every object with its attributes."))


def phase2_query(attributes: Column) -> Column:
    return F.concat(F.lit("Attributes: "), attributes, F.lit("\nList the plain nouns behind these attributes that are missing."))


def yes_no_question(label: Column) -> Column:
    return F.concat(F.lit("Does this picture show "), label, F.lit("? Answer yes or no."))


def dialog(system: str, query: Column) -> Column:
    """[{role, content}] of one exchange."""
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(turn("system", F.lit(system)), turn("user", query))


def with_model(df: DataFrame, column: str, out: str, model: Callable[[pd.Series], pd.DataFrame], schema: str, batch: str | None = None) -> DataFrame:
    """Run a batch model over a column; its columns, and `error` where a batch failed, are added.

    Batches are Arrow's, or, with `batch`, the rows of each value of that column
    (see batches.cost_batches), whatever partitions and Arrow batches they come in.
    Arrow's hold only the column itself, and no more than BATCH_BYTES, for the
    session; all other columns stay with Spark.

    `model` maps a Series to a frame with the columns of `schema`. A failing
    batch keeps its rows with the error's text.
    """
    names = [f.split()[0] for f in schema.split(", ")]

    def asked(given: pd.Series) -> tuple[pd.DataFrame, str | None]:
        try:
            got = model(given).reset_index(drop=True)[names]
            if len(got) != len(given):
                raise ValueError(f"{len(got)} answers to {len(given)} rows")
            return got, None
        except Exception as e:  # noqa: BLE001
            return pd.DataFrame({n: [None] * len(given) for n in names}), str(e)

    if batch:
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

        def answered(b: pd.DataFrame) -> pd.DataFrame:
            got, error = asked(b[column])
            return pd.concat([b.reset_index(drop=True), got, pd.DataFrame({out: [error] * len(b)})], axis=1)

        return df.groupBy(batch).applyInPandas(answered, f"{fields}, {schema}, {out} string")

    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    kind = T.StructType([*T.StructType.fromDDL(schema).fields, T.StructField(out, T.StringType())])
    parts = list(to_arrow_schema(kind))

    @F.arrow_udf(kind)
    def answers(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for given in batches:
            got, error = asked(given.to_pandas())
            got[out] = pd.Series([error] * len(given), dtype=object)
            yield pa.StructArray.from_arrays([pa.Array.from_pandas(got[f.name], type=f.type) for f in parts], fields=parts)

    # Said to vary, so that no filter asks the model again.
    said = df.withColumn("_said", answers.asNondeterministic()(F.col(column)))
    return said.select(*[F.col(f"`{c}`") for c in df.columns], *[F.col(f"_said.{f.name}").alias(f.name) for f in kind])


def offline_describe(images: pd.Series) -> pd.DataFrame:
    """Stand-in for an image-text model: the number of bytes, in words."""
    return pd.DataFrame({"vlm_caption": [f"This is a picture of {len(x or b'')} bytes." for x in images]})


def offline_chat(queries: pd.Series) -> pd.DataFrame:
    """Stand-in for a chat model: the longer words of the query, numbered."""
    def answer(q: str) -> str:
        seen = dict.fromkeys(w.strip(".,") for w in (q or "").lower().split() if len(w.strip(".,")) > 5)
        return PHASE1_HEADER + "\n" + "\n".join(f"{i}. {w}" for i, w in enumerate(seen, 1))

    return pd.DataFrame({"answer": [answer(q) for q in queries]})


def offline_judge(questions: pd.Series) -> pd.DataFrame:
    """Stand-in for a yes/no model: probabilities from the question's length."""
    yes = [(len(q or "") % 10) / 10 for q in questions]
    return pd.DataFrame({"answer": ["yes" if y >= 0.5 else "no" for y in yes], "yes_prob": yes, "no_prob": [1 - y for y in yes]})
