"""Questions to answers: retrieval, context, generation by a pluggable model, quality and usage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as T

from .filters import Filters, document_filter
from .search import diverse_top_k, token_prefix, with_scores

NO_DOCUMENTS = "No documents are available. Add documents before asking."
NO_QUESTION = "A question is needed."
NO_CHUNKS = "No relevant passages were found for this question."


def find_relevant_chunks(queries: DataFrame, chunks: DataFrame, k, filters: Filters | None = None) -> DataFrame:
    """For each query the diverse best chunks: sound embeddings, similarity above the bound, ``rank``. Vectors of another length are passed over, whatever the bound.

    ``k`` None gives all of them, without ranks, so that no task has to order all chunks of a query.
    """
    f = filters or Filters()
    scored = with_scores(queries, chunks.where(document_filter(f)).where(F.size("embedding") > 0), strict=True)
    sound = scored.where(F.col("semantic").isNotNull() & ~F.isnan("semantic") & (F.col("semantic") >= f.similarity()))
    sourced = sound.withColumn("label", T.source_label("source", "chunk_index")).withColumnRenamed("semantic", "similarity")
    carried = [c for c in queries.columns if c not in ("query_id", "question", "embedding")]
    sourced = sourced.join(queries.select("query_id", *carried), "query_id") if carried else sourced
    return sourced if k is None else diverse_top_k(sourced, k, source="label")


def query_simple(queries: DataFrame, chunks: DataFrame, **options) -> DataFrame:
    """Answers of simple level: ``answer``, ``sources``, ``relevance``, ``retrieved``."""
    return ask(queries, chunks, level="simple", **options).select("query_id", "answer", "sources", "relevance", "retrieved")


INSTRUCTIONS = "Answer from the passages given, cite them, and use Markdown."
#: How an answer of each kind of question should look.
FORMATS = {
    "summary": "Begin with an overview, then sections with headings.",
    "analysis": "Give the reasoning, its evidence and what follows from it.",
    "timeline": "List dates and events in order, in a table.",
    "data": "Put numbers in tables with units.",
    "process": "Number the steps.",
    "comparison": "Compare side by side in a table.",
    "general": "Answer directly, under headings where they help.",
}


def system_prompt(kind) -> Column:
    """What a model is told before a question of some kind; an unknown kind is a general one."""
    k = T.col(kind)
    return F.concat(F.lit(INSTRUCTIONS + "\n\n"), T.first_match([(k == name, form) for name, form in FORMATS.items()], FORMATS["general"]))


def context_prompt(question, context) -> Column:
    return F.concat(F.lit("Context:\n"), T.col(context), F.lit("\n\nQuestion: "), T.col(question))


def critique_prompt(question, answer) -> Column:
    return F.concat(F.lit("Review this answer.\n\nQuestion: "), T.col(question), F.lit("\nAnswer: "), T.col(answer))


def refinement_prompt(question, answer, critique) -> Column:
    return F.concat(
        F.lit("Question: "), T.col(question), F.lit("\n\nAnswer: "), T.col(answer), F.lit("\n\nImprove: "), T.col(critique)
    )


def chat_lines(messages) -> Column:
    """``role: content`` lines of an array of messages."""
    return F.array_join(F.transform(messages, lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n")


def ask(
    queries: DataFrame,
    chunks: DataFrame,
    token_budget: int = 4000,
    level: str | Column | None = None,
    filters: Filters | None = None,
    generate: Callable[[Column], Column] = T.offline_answer,
    show_thinking: bool = False,
) -> DataFrame:
    """One row for each query: answer, sources, chunks, relevance, quality and token use.

    ``generate`` maps a prompt column to an answer column: a UDF that calls a model, or the offline
    stand-in. Simple questions skip the critique.
    """
    level = T.complexity("question") if level is None else F.lit(level) if isinstance(level, str) else level
    typed = (
        queries.withColumn("kind", T.question_type("question"))
        .withColumn("level", level)
        .withColumn("k", T.chunk_limit("kind"))
        .withColumn("budget", T.token_allocation(F.lit(token_budget), "level"))
    )
    found = find_relevant_chunks(typed, chunks, F.col("k"), filters).withColumn("tokens", T.estimate_tokens("content"))
    fitting = token_prefix(found, F.col("budget.prefix"))
    gathered = fitting.groupBy("query_id").agg(
        F.sort_array(F.collect_list(F.struct("rank", "label", "similarity", "content"))).alias("retrieved"),
        F.avg(F.coalesce("similarity", F.lit(0.0))).alias("relevance"),
    )
    asked = typed.join(gathered, "query_id", "left")
    retrieved = F.coalesce("retrieved", F.array())
    blank = T.trim(F.coalesce("question", F.lit(""))) == ""
    n, none = F.size("retrieved"), F.col("retrieved").isNull() | blank
    refused = F.when(blank, NO_QUESTION).when(F.lit(not chunks.limit(1).count()), NO_DOCUMENTS).otherwise(NO_CHUNKS)
    context = F.array_join(F.transform(retrieved, lambda c: c["content"]), "\n\n")
    first = asked.withColumn("prompt", context_prompt("question", context)).withColumn(
        "initial", F.when(none, refused).otherwise(generate(F.col("prompt")))
    )
    simple = F.col("level") == "simple"
    reviewed = first.withColumn("critique", F.when(~simple & ~none, generate(critique_prompt("question", "initial"))))
    issues = F.coalesce(T.critique_flags("critique"), F.array())
    refined = reviewed.withColumn("issues", issues).withColumn(
        "final",
        F.when(none, F.col("initial"))
        .when(simple, T.clean_response("initial"))
        .otherwise(T.clean_response(generate(refinement_prompt("question", "initial", "critique")))),
    )
    thinking = F.concat(F.lit("## Reasoning\n\n"), T.thinking_preview("initial"), F.lit("\n\n"), T.thinking_preview("critique"), F.lit("\n\n## Response\n\n"), F.col("final"))
    answer = F.when(F.col("critique").isNotNull(), thinking).otherwise(F.col("final")) if show_thinking else F.col("final")
    similarity = F.get(F.col("retrieved.similarity"), F.lit(0))
    context_tokens = T.estimate_tokens("prompt") + T.estimate_tokens("initial")
    reasoning = F.coalesce(T.estimate_tokens("critique"), F.lit(0).cast("long"))
    response = T.estimate_tokens("final")
    return refined.select(
        "query_id", "question", "kind", "level", answer.alias("answer"),
        F.array_distinct(F.transform(retrieved, lambda c: c["label"])).alias("sources"),
        F.coalesce("relevance", F.lit(0.0)).alias("relevance"),
        retrieved.alias("retrieved"),
        F.col("critique"), "issues",
        T.quality_metrics("final", F.coalesce(F.when(none, 0).otherwise(n), F.lit(0)), similarity, F.size("issues")).alias("quality"),
        F.struct(
            context_tokens.alias("context"), reasoning.alias("reasoning"), response.alias("response"),
            (context_tokens + reasoning + response).alias("total"),
        ).alias("tokens"),
    )
