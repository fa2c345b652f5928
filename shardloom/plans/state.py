"""The state machines of a move and of its tasks, as tables of transitions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values: (command, state) to the new state; anything else is refused with the command's reason.
COMMANDS = {
    ("START", None): "RUNNING", ("START", "COMPLETED"): "RUNNING", ("START", "IDLE"): "RUNNING", ("START", "FAILED"): "RUNNING",
    ("STOP", "RUNNING"): "STOPPED", ("RESUME", "STOPPED"): "RUNNING",
}
REFUSED = {
    ("START", "RUNNING"): "another move is under way",
    ("START", "STOPPED"): "a stopped move is waiting to be resumed",
    ("STOP", None): "nothing to stop: no move is under way",
    ("RESUME", None): "nothing to resume: no move is stopped",
}
#: (event, state) of a task to its new state.
TASK_EVENTS = {
    ("CLAIM", "CREATED"): "ASSIGNED", ("CLAIM", "AVAILABLE"): "ASSIGNED", ("BEGIN", "ASSIGNED"): "RUNNING",
    ("COMPLETE", "RUNNING"): "COMPLETED", ("RELEASE", "RUNNING"): "AVAILABLE", ("RELEASE", "ASSIGNED"): "AVAILABLE",
}


def command(what: str, status: str | None) -> tuple[str | None, str | None]:
    """(the state after a command, why it is refused)."""
    if (what, status) in COMMANDS:
        return COMMANDS[what, status], None
    return status, REFUSED.get((what, status)) or REFUSED[what, None]


def command_result(what: Column, status: Column) -> Column:
    """The same as a struct (accepted, status, reason)."""
    out = None
    states = sorted({s for _, s in COMMANDS if s} | {"STOPPED"}) + [None]
    for c in ("START", "STOP", "RESUME"):
        for s in states:
            after, why = command(c, s)
            value = F.struct(F.lit(why is None).alias("accepted"), F.lit(after).cast("string").alias("status"), F.lit(why).cast("string").alias("reason"))
            fits = (what == c) & status.eqNullSafe(F.lit(s))
            out = F.when(fits, value) if out is None else out.when(fits, value)
    return out


def task_after(event: Column, status: Column) -> Column:
    """A task's state after an event; its own state if the event doesn't apply."""
    out = status
    for (e, s), after in TASK_EVENTS.items():
        out = F.when((event == e) & (status == s), F.lit(after)).otherwise(out)
    return out
