"""Vocabulary of claims. Fixed values of the data model: names, ranks and policies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Trust in who asserted a claim.
TRUST = {"user": 5, "user_confirmed": 5, "participant": 4, "document_author": 3, "assistant_inferred": 2, "system": 1}
TRUSTED_USERS = ("user", "user_confirmed")
#: Who must have said what a profile is made of, and what a digest may tell.
PROFILE_KINDS = ("user", "user_confirmed", "system")
#: Words of labels and descriptions that tell an organization.
ORGANIZATION_WORDS = (
    r"agency|association|bank|b\.?v\.?|business|chapter|club|collective|college|committee|community|company|cooperative|corp\.?|corporation|council|crew|department|employer|firm|foundation|gmbh|group|guild|inc\.?|"
    r"institution|institute|labs?|llc|ltd\.?|ngo|non-?profit|office|org|organisation|organization|partnership|school|society|startup|studio|team|university"
)
#: Predicates of which a subject has one current value; DUE_ON only of a Task.
SINGLE_CURRENT = ("HAS_STATUS", "HAS_TASK_STATUS", "ASSIGNED_TO")
SINGLE_CURRENT_OF_TASK = ("DUE_ON",)
FEEDS_ATLAS = ("HAS_STATUS", "HAS_PREFERENCE", "HAS_GOAL")
FORCE_REFRESH = ("HAS_STATUS", "HAS_TASK_STATUS")
STRUCTURAL_TYPES = ("Temporal", "Atlas", "AssistantDream")
OPEN_STATUSES = ("pending", "in_progress")
#: Spellings of task states, normalised (lower case, blanks and dashes as underscores), beside the states themselves.
TASK_STATUS = {
    "pending": "pending", "in_progress": "in_progress", "done": "done", "abandoned": "abandoned",
    "completed": "done", "complete": "done", "finished": "done", "cancelled": "abandoned", "canceled": "abandoned", "dropped": "abandoned", "failed": "abandoned",
    "todo": "pending", "to_do": "pending", "not_started": "pending", "doing": "in_progress", "started": "in_progress", "wip": "in_progress",
}


def lookup(pairs: dict, key: Column) -> Column:
    """A value from a small fixed mapping; null if absent."""
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])[key]


def trust_rank(kind: Column) -> Column:
    return F.coalesce(lookup(TRUST, kind), F.lit(0))
