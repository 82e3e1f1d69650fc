"""Finding the reply inside raw run output."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glosswork.functions.text import let, py_strip
from glosswork.functions.variants import field, lenient_json, set_aside, text_of

# The fence around a JSON reply, and the markers of an agent message event.
FENCE_OPEN = "```json"
FENCE_CLOSE = "```"
EVENT_COMPLETED = "item.completed"
AGENT_MESSAGE = "agent_message"


def text_after(c: Column, mark: str) -> Column:
    """What follows the first ``mark``; NULL when there is none."""
    at = F.instr(c, F.lit(mark))
    return F.when(at > 0, F.substring(c, at + len(mark), F.length(c)))


def text_before_last(c: Column, mark: str) -> Column:
    """What precedes the last ``mark``; NULL when there is none."""
    tail = F.length(F.substring_index(c, mark, -1))
    return F.when(
        F.contains(c, F.lit(mark)), F.substring(c, F.lit(1), F.length(c) - tail - len(mark))
    )


def strip_fence(c: Column) -> Column:
    """Between the first opening and the last closing fence; NULL when either is missing."""
    return let(text_after(c, FENCE_OPEN), lambda rest: text_before_last(rest, FENCE_CLOSE))


def unfenced(c: Column) -> Column:
    """The fenced part of a text, or the text itself when nothing is fenced."""
    return F.coalesce(strip_fence(c), c)


def may_be_message(line: Column) -> Column:
    """Cheap test every agent message passes: the type is spelled out, or hidden in escapes."""
    return F.contains(line, F.lit(AGENT_MESSAGE)) | F.contains(line, F.lit("\\u"))


def agent_message(line: Column) -> Column:
    """Text of an agent message event in either shape, fence removed; NULL for other lines."""

    def message(event: Column, aside: Column) -> Column:
        current = F.when(
            (text_of(field(event, "type")) == EVENT_COMPLETED)
            & (text_of(field(event, "item.type")) == AGENT_MESSAGE),
            text_of(field(event, "item.text"), aside),
        )
        legacy = F.when(
            text_of(field(event, "msg.type")) == AGENT_MESSAGE,
            text_of(field(event, "msg.message"), aside),
        )
        return F.coalesce(current, legacy)

    def read(aside: Column) -> Column:
        return let(lenient_json(aside["text"]), lambda event: message(event, aside))

    return let(let(set_aside(F.when(may_be_message(line), py_strip(line))), read), unfenced)
