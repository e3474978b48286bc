"""Scope guard, prompts and parsing of completions, as column expressions over a query table.

No completion service ships with the engine: `completed` takes a user's function.
"""

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketloom import fixed_values as fv
from ticketloom.functions import text as tx


def fill(template: str, **values: Column) -> Column:
    """A text template with `{name}` places filled from columns."""
    pieces, rest = [], template
    while rest:
        spots = [(rest.index("{" + n + "}"), n) for n in values if "{" + n + "}" in rest]
        if not spots:
            pieces.append(F.lit(rest))
            break
        at, name = min(spots)
        pieces += [F.lit(rest[:at]), values[name]]
        rest = rest[at + len(name) + 2:]
    return F.concat(*pieces)


def is_blank(query: Column) -> Column:
    return F.coalesce(tx.strip(query) == "", F.lit(True))


def guard_reason(query: Column) -> Column:
    """Why a query is out of scope by the fixed patterns; null when none matches."""
    body = tx.strip(query)
    tests = [
        F.when(body.rlike("(?iU)" + tx.widen(pattern)), F.lit(reason))
        for reason, pattern in fv.GUARD_RULES
    ]
    return F.coalesce(*tests)


def block_message(reason: Column) -> Column:
    """The reader's message for a block reason; null stays null."""
    known = F.create_map(*[F.lit(x) for pair in fv.BLOCK_MESSAGES.items() for x in pair])
    message = F.coalesce(F.try_element_at(known, reason), F.lit(fv.BLOCK_MESSAGE_DEFAULT))
    return F.when(reason.isNotNull(), message)


def guarded(queries: DataFrame, query: str = "query", verdict: str | None = None) -> DataFrame:
    """Add the block reason with its code, message and hint; null where a query may pass.

    The fixed patterns come first. `verdict` names the column of a topic classifier's answers: an
    explicit NO blocks what no pattern has blocked.
    """
    reason = guard_reason(F.col(query))
    if verdict is not None:
        second = F.when(~is_allowed(F.col(verdict)), F.lit(fv.BLOCK_CODE))
        reason = F.coalesce(reason, second)
    judged = queries.withColumn("reason", reason)
    blocked = F.col("reason").isNotNull()
    return judged.withColumns({
        "code": F.when(blocked, F.lit(fv.BLOCK_CODE)),
        "message": block_message(F.col("reason")),
        "hint": F.when(blocked, F.lit(fv.SCOPE_HINT)),
    })


def split_blank(queries: DataFrame, query: str = "query") -> tuple[DataFrame, DataFrame]:
    """Answerable queries and the rejected blank ones."""
    blank = is_blank(F.col(query))
    return queries.filter(~blank), queries.filter(blank)


def guard_prompt(query: Column) -> Column:
    return fill(fv.GUARD_PROMPT, query=F.substring(tx.strip(query), 1, fv.GUARD_QUERY_CHARS))


def is_allowed(verdict: Column) -> Column:
    """Anything but an explicit NO lets a query through."""
    return ~F.upper(F.substring(tx.strip(F.coalesce(verdict, F.lit(""))), 1, 3)).startswith("NO")


def short_number(value: Column) -> Column:
    """Four digits at most, without trailing zeros: 0.71, 1.0."""
    digits = F.round(value, 4).cast("decimal(12,4)").cast("string")
    return F.regexp_replace(digits, r"(\.\d+?)0+$", "$1")


def context_block(hit: Column) -> Column:
    """One past case: heading, customer text and, when there is one, the resolution."""
    def shown(value: Column) -> Column:
        return F.coalesce(value.cast("string"), F.lit("None"))

    heading = F.concat(
        F.lit("["), shown(hit["airline"]), F.lit(" | "), shown(hit["priority"]),
        F.lit(" | similarity="), short_number(hit["similarity"]), F.lit("]\nCustomer: "),
        shown(hit["text"]),
    )
    response = hit["agent_response"]
    return F.when(
        F.coalesce(response, F.lit("")) != "", F.concat(heading, F.lit("\nResolution: "), response)
    ).otherwise(heading)


def context_text(hits: Column) -> Column:
    """The blocks of a query's hits, a blank line between them."""
    return F.array_join(F.transform(hits, context_block), "\n\n")


def answer_prompt(query: Column, hits: Column) -> Column:
    """The grounded prompt, or the general one when nothing was retrieved."""
    with_hits = fill(fv.CONTEXT_PROMPT, context=context_text(hits), query=query)
    return F.when(F.coalesce(F.size(hits), F.lit(0)) > 0, with_hits).otherwise(
        fill(fv.NO_CONTEXT_PROMPT, query=query)
    )


def label_prompt(text: Column) -> Column:
    return fill(fv.LABEL_PROMPT, query=text)


def parsed_label(completion: Column) -> Column:
    """URGENT when the word occurs anywhere, else NORMAL; 'NOT URGENT' reads URGENT."""
    return F.when(F.upper(completion).contains("URGENT"), "URGENT").otherwise("NORMAL")


def is_error(completion: Column) -> Column:
    """Whether the text is a provider failure rather than an answer."""
    return F.coalesce(completion.startswith(fv.COMPLETION_ERROR_PREFIX), F.lit(True))


def completed(prompts: DataFrame, completer: Callable[[pd.Series], pd.DataFrame],
              prompt: str = "prompt") -> DataFrame:
    """Run a user's completer over a prompt column, batch by batch.

    The completer maps a series of prompts to a frame with `completion`, `input_tokens`,
    `output_tokens` and `provider` in the same order.
    """
    added = "completion string, input_tokens long, output_tokens long, provider string"
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch.reset_index(drop=True)
            yield pd.concat([batch, completer(batch[prompt]).reset_index(drop=True)], axis=1)

    return prompts.mapInPandas(run, f"{fields}, {added}")
