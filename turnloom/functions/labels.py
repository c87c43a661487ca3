"""Dialogue-act vocabulary and the column expressions that read it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Label groups, abbreviations, thresholds and codes that results depend on.

EXTENDED_GROUPS = {
    "canonical_questions": ["Wh-Question", "Yes-No-Question", "Open-Question", "Or-Clause"],
    "non_canonical_questions": [
        "Declarative-Yes-No-Question", "Rhetorical-Questions", "Backchannel-in-question-form",
        "Tag-Question", "Declarative-Wh-Question",
    ],
    "canonical_answers": ["Yes-answers", "No-answers"],
    "non_canonical_answers": [
        "Affirmative-non-yes-answers", "Other-answers", "Negative-non-no-answers",
        "Dispreferred-answers", "Reject",
    ],
    "backchannel": [
        "Hold-before-answer-agreement", "Acknowledge-Backchannel", "Response-Acknowledgement",
        "Non-verbal", "Uninterpretable", "Other",
    ],
    "statements": ["Statement-non-opinion", "Statement-opinion"],
    "hedge": ["Hedge"],
    "social_ritual": [
        "Conventional-opening", "Conventional-closing", "Thanking", "Apology", "Appreciation",
        "Downplayer",
    ],
    "acknowledgement": ["Agree-Accept", "Signal-non-understanding"],
    "elaboration": [
        "Summarize/reformulate", "Repeat-phrase", "Collaborative-Completion", "Quotation",
    ],
    "action": ["Action-directive", "Offers-Options-Commits"],
    "noise": ["3rd-party-talk"],
}

CORE_GROUPS = {
    "canonical_questions": ["Wh-Question", "Yes-No-Question", "Open-Question", "Or-Clause"],
    "non_canonical_questions": [
        "Declarative-Yes-No-Question", "Rhetorical-Questions", "Backchannel-in-question-form",
        "Tag-Question", "Declarative-Wh-Question",
    ],
    "backchannel": ["Hold-before-answer-agreement", "Acknowledge-Backchannel"],
    "canonical_answers": ["Yes-answers", "No-answers"],
    "non_canonical_answers": [
        "Affirmative-non-yes-answers", "Other-answers", "Negative-non-no-answers",
        "Dispreferred-answers", "Reject",
    ],
    "statements": ["Statement-non-opinion", "Statement-opinion"],
    "hedge": ["Hedge"],
}

GROUP_ABBREVIATIONS = {
    "canonical_questions": "CQ",
    "non_canonical_questions": "NCQ",
    "canonical_answers": "CA",
    "non_canonical_answers": "NCA",
    "backchannel": "BC",
    "statements": "ST",
    "hedge": "HG",
    "social_ritual": "SR",
    "acknowledgement": "ACK",
    "elaboration": "EL",
    "action": "ACT",
    "noise": "NS",
    "other": "OT",
}

RAW_ABBREVIATIONS = [
    ("-Question", "-Q"),
    ("-answers", "-A"),
    ("Statement-", "ST-"),
    ("Acknowledge-", "Ack-"),
    ("Conventional-", "Conv-"),
    ("Collaborative-", "Collab-"),
]

RUN_LENGTH_LIMITS = {"statements": (2, 8)}
DEFAULT_RUN_LENGTH_LIMITS = (1, 3)

CODE_DESCRIPTIONS = {
    "BCS": "Building coping skills to avoid substance use",
    "ERT": "Emphasizing ongoing reality testing",
    "ECE": "Encouraging patients to engage in corrective experiences",
    "FTA": "Facilitating the therapeutic alliance",
    "FSU": "Focusing directly on substance use",
    "HPM": "Fostering hope, positive expectations, and motivation",
    "IDR": "Identifying resources",
    "IAI": "Increasing awareness and insight",
    "STK": "Social talk",
    "VLD": "Validating",
}

CLUSTER_A_CODES = ["IAI", "BCS", "FSU", "VLD"]
QUESTION_GROUPS = ["canonical_questions", "non_canonical_questions"]
RESPONSE_GROUPS = ["statements", "hedge"]
EMPTY_CODES = ["", "nan", "NaN", "None"]
INSIDE_LABEL = "I-"
OTHER = "other"


def members(groups: dict[str, list[str]]) -> dict[str, str]:
    """Invert a group table to label -> group."""
    return {label: group for group, labels in groups.items() for label in labels}


def lookup(key: Column, table: dict[str, str], default: Column | None = None) -> Column:
    """Constant-folded map lookup; a fixed table needs no join."""
    entries = F.create_map(*[F.lit(item) for pair in table.items() for item in pair])
    found = F.try_element_at(entries, key)
    return found if default is None else F.coalesce(found, default)


def extended_group(label: Column) -> Column:
    return lookup(label, members(EXTENDED_GROUPS), F.lit(OTHER))


def core_group(label: Column, default: str | None = None) -> Column:
    return lookup(label, members(CORE_GROUPS), None if default is None else F.lit(default))


def pick_label(granularity: str, label: str = "proc_da", group: str = "da_group") -> Column:
    """`groups` reads the group column, `raw` the label itself."""
    if granularity not in ("groups", "raw"):
        raise ValueError(f"granularity must be 'groups' or 'raw', not {granularity!r}")
    return F.col(group if granularity == "groups" else label)


def bucket_suffix(base: Column, run_length: Column, granularity: str) -> Column:
    """short / medium / long, with the thresholds of the label's group."""
    group = base if granularity == "groups" else extended_group(base)

    def limit(which: int) -> Column:
        chosen = F.lit(DEFAULT_RUN_LENGTH_LIMITS[which])
        for name, limits in RUN_LENGTH_LIMITS.items():
            chosen = F.when(group == name, F.lit(limits[which])).otherwise(chosen)
        return chosen

    return (
        F.when(run_length <= limit(0), "short")
        .when(run_length <= limit(1), "medium")
        .otherwise("long")
    )


def bucket_label(base: Column, run_length: Column, granularity: str) -> Column:
    return F.concat_ws("_", base, bucket_suffix(base, run_length, granularity))


def strip_bucket(label: Column) -> Column:
    return F.regexp_replace(label, "_(short|medium|long)$", "")


def abbreviate(label: Column, granularity: str) -> Column:
    """Short display form; a run-length suffix becomes _S, _M or _L."""
    base = strip_bucket(label)
    suffix = (
        F.when(label.endswith("_short"), "_S")
        .when(label.endswith("_medium"), "_M")
        .when(label.endswith("_long"), "_L")
        .otherwise("")
    )
    if granularity == "groups":
        short = lookup(base, GROUP_ABBREVIATIONS, base)
    else:
        short = base
        for long_form, short_form in RAW_ABBREVIATIONS:
            short = F.replace(short, F.lit(long_form), F.lit(short_form))
    return F.concat(short, suffix)


def parse_codes(cell: Column, default: str | None = "NA") -> Column:
    """Comma-separated cell to a clean array; nothing usable gives [default]."""
    parts = F.transform(F.split(cell, ","), lambda c: F.regexp_replace(c, r"^\s+|\s+$", ""))
    clean = F.filter(F.coalesce(parts, F.array().cast("array<string>")),
                     lambda c: ~c.isin(*EMPTY_CODES))
    if default is None:
        return clean
    return F.when(F.size(clean) == 0, F.array(F.lit(default))).otherwise(clean)


def describe_code(code: Column) -> Column:
    return lookup(code, CODE_DESCRIPTIONS, F.lit("NA"))


def therapist_before_marker(name: Column) -> Column:
    """The one character before `_with`, else `unknown`."""
    found = F.regexp_extract(name, "(.)_with", 1)
    return F.when(found == "", "unknown").otherwise(found)


def therapist_in_prefix(name: Column) -> Column:
    """Digits after `T` ahead of the first underscore, else `unknown`."""
    stem = F.regexp_replace(name, r"(.)\.[^.]*$", "$1")
    found = F.regexp_extract(F.substring_index(stem, "_", 1), r"(?i)T(\d+)", 1)
    return F.when(found == "", "unknown").otherwise(found)


def patient_in_name(name: Column) -> Column:
    """Two digits after `AC`; null when the name has none."""
    stem = F.regexp_replace(name, r"(.)\.[^.]*$", "$1")
    found = F.regexp_extract(stem, r"(?i)AC(\d{2})", 1)
    return F.when(found != "", found)


def normalise_speaker(raw: Column) -> Column:
    return F.when(F.lower(F.trim(raw)) == "therapist", "therapist").otherwise("patient")


def clock_seconds(text: Column) -> Column:
    """`m:ss` or `h:mm:ss` to seconds; anything else to a plain number or null."""
    parts = F.split(text, ":")
    number = lambda i: F.element_at(parts, i).try_cast("double")
    return (
        F.when(F.size(parts) == 3, number(1) * 3600 + number(2) * 60 + number(3))
        .when(F.size(parts) == 2, number(1) * 60 + number(2))
        .otherwise(text.try_cast("double"))
    )
