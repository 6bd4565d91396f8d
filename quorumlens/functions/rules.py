"""Fixed values of extraction: rule patterns with their base confidence, and helper patterns.

A pattern is searched without regard to case; its place in a list breaks ties. Patterns keep to what Java's and
RE2's engines read alike.
"""

from __future__ import annotations

VERY_HIGH, HIGH, MEDIUM_HIGH, MEDIUM, LOW = 0.95, 0.85, 0.75, 0.6, 0.45
HEDGE_PENALTY = 0.2
OWNER_DEADLINE_BOOST = 0.1
QUANTITY_BOOST = 0.15

#: Canonical order of types.
TYPES = ("decision", "commitment", "open_loop", "risk", "assumption", "question", "fact")
STATUSES = ("active", "archived", "superseded", "resolved", "deleted")

WEEKDAYS = "monday|tuesday|wednesday|thursday|friday|saturday|sunday"

RULES: dict[str, tuple[tuple[str, float], ...]] = {
    "decision": (
        (r"\bwe(?:'ve| have| had)? decided\b", VERY_HIGH),
        (r"\bwe agreed\b", HIGH),
        (r"\b(?:the |final )?decision is\b", HIGH),
        (r"\bfinal call(?: is)?\b", HIGH),
        (r"\blet'?s go with\b", HIGH),
        (r"\bapproved\b", HIGH),
        (r"\bwe will use\b", MEDIUM_HIGH),
        (r"\bwe'?ll go with\b", MEDIUM_HIGH),
    ),
    "commitment": (
        (r"\bassigned to\b", HIGH),
        (r"\bI(?:'ll| will)\b", HIGH),
        (r"\bplease take\b", MEDIUM_HIGH),
        (r"\bplease (?:handle|own|prepare|send|review|follow up)\b", MEDIUM_HIGH),
        (r"\bwe will\b", MEDIUM),
        (r"\bcan you\b", MEDIUM),
        (rf"\bby (?:{WEEKDAYS})\b", MEDIUM),
        (r"\bbefore (?:the )?next meeting\b", MEDIUM),
    ),
    "open_loop": (
        (r"\bneeds? to (?:be )?decide(?:d)?\b", HIGH),
        (r"\bto be (?:confirmed|decided|determined)\b", HIGH),
        (r"\b(?:not resolved|unresolved)\b", HIGH),
        (r"\bTBD\b", HIGH),
        (r"\bopen question\b", MEDIUM_HIGH),
        (r"\bstill open\b", MEDIUM_HIGH),
        (r"\bfollow[ -]?up\b", MEDIUM_HIGH),
        (r"\bcircle back\b", MEDIUM),
        (r"\bpending\b", MEDIUM),
    ),
    "risk": (
        (r"\bblock(?:er|ed|ing)\b", HIGH),
        (r"\b(?:might|may|could) fail\b", HIGH),
        (r"\brisk(?:s|y)?\b", MEDIUM_HIGH),
        (r"\bconcern(?:s|ed)?\b", MEDIUM_HIGH),
        (r"\bdepend(?:s|ency|encies|ent)\b", MEDIUM_HIGH),
        (r"\bdelay(?:s|ed|ing)?\b", MEDIUM_HIGH),
        (r"\bbottleneck\b", MEDIUM),
    ),
    "assumption": (
        (r"\bbased on the assumption\b", VERY_HIGH),
        (r"\bwe(?:'re| are)? assum(?:e|ing)\b", HIGH),
        (r"\bassum(?:e|es|ing|ption)\b", HIGH),
        (r"\bif this holds\b", MEDIUM_HIGH),
        (r"\bpresumably\b", MEDIUM),
    ),
    "question": (
        (r"\bquestion is\b", HIGH),
        (r"\bcan we\b", MEDIUM_HIGH),
        (r"\bshould we\b", MEDIUM_HIGH),
        (r"\bdo we\b", MEDIUM),
        (r"\bwhat about\b", MEDIUM),
    ),
    "fact": (
        (r"\b(?:customers?|clients?|accounts?)\b", MEDIUM),
        (r"\brequirements?\b|\bmust (?:support|have|be)\b|\bspec(?:ification)?s?\b", MEDIUM),
        (r"\bbudget\b|\bconstraints?\b|\bcap(?:ped)?\b|\blimit(?:s|ed|ation)?\b", MEDIUM),
        (r"\bdeadline\b|\blaunch(?:es|ed|ing)?\b|\brelease\b|\btimeline\b|\bmilestone\b|\bschedule\b", MEDIUM),
        (r"\brevenue\b|\bgrowth\b|\bchurn\b|\bMRR\b|\bARR\b|\blatency\b|\buptime\b|\bconversion\b|\busers?\b", MEDIUM),
        (r"\bprojects?\b|\broadmap\b|\bversions?\b", LOW),
    ),
}

#: For each rule, in its place: strings one of which stands in every match once it is in lower case. Searching for
#: them is far cheaper than the pattern, and tells for most texts that it need not be tried.
PARTS: dict[str, tuple[tuple[str, ...], ...]] = {
    "decision": (("decided",), ("we agreed",), ("decision is",), ("final call",), ("go with",), ("approved",), ("we will use",), ("ll go with",)),
    "commitment": (("assigned to",), ("i'll", "i will"), ("please take",), ("please ",), ("we will",), ("can you",), ("by ",), ("next meeting",)),
    "open_loop": (("decide",), ("to be ",), ("resolved",), ("tbd",), ("open question",), ("still open",), ("follow",), ("circle back",), ("pending",)),
    "risk": (("block",), ("fail",), ("risk",), ("concern",), ("depend",), ("delay",), ("bottleneck",)),
    "assumption": (("based on the assumption",), ("assum",), ("assum",), ("if this holds",), ("presumably",)),
    "question": (("question is",), ("can we",), ("should we",), ("do we",), ("what about",)),
    "fact": (
        ("customer", "client", "account"), ("requirement", "must ", "spec"), ("budget", "constraint", "cap", "limit"), ("deadline", "launch", "release", "timeline", "milestone", "schedule"),
        ("revenue", "growth", "churn", "mrr", "arr", "latency", "uptime", "conversion", "user"), ("project", "roadmap", "version"),
    ),
}

#: Patterns of text that results depend on.
HEDGES = r"\b(?:maybe|might|perhaps|possibly|potentially|probably|i think|i guess|i suppose|not sure|kind of|sort of|could be|tentatively)\b"
QUANTITY = r"(?:\d+(?:\.\d+)?\s?%|\$\s?\d|\b\d+(?:\.\d+)?[kKmMbB]?\b|\bQ[1-4]\b|\b\d{4}\b)"
ASSIGNEE = r"\bassigned to ([A-Z][\w.'-]*(?: [A-Z][\w.'-]*)?)"
FIRST_PERSON = r"\bI(?:'ll| will)\b"
DUE = (
    r"\b(?:by (?:end of (?:day|week|month)|eod|cob|today|tomorrow|next week|next month|"
    rf"{WEEKDAYS}|\w+ \d{{1,2}}(?:st|nd|rd|th)?|\d{{1,2}}/\d{{1,2}})|before (?:the )?next meeting)\b"
)

#: Technologies that are known without a vocabulary of one's own, and what names things.
TECHNOLOGIES = (
    "postgres postgresql mysql sqlite mongodb redis kafka rabbitmq elasticsearch snowflake spark hadoop python java"
    " javascript typescript go rust react vue angular django flask fastapi node docker kubernetes terraform aws gcp"
    " azure graphql grpc rest"
).split()
DOCUMENT_WORDS = ("runbook", "spec", "rfc", "playbook")
PROJECT = r"\b(?i:project)\s+([A-Z][A-Za-z0-9]+)\b"
CUSTOMER = r"\b(?i:customer|client)\s+([A-Z][A-Za-z0-9]+)\b"
VENDOR = r"\b(?i:vendor)\s+([A-Z][A-Za-z0-9]+)\b"
DOCUMENT_FILE = r"(?i)\b([\w-]+\.(?:md|doc|docx|pdf|txt))\b"

#: How much a status counts in a search, and how much each part of a score does.
STATUS_WEIGHTS = {"active": 1.0, "resolved": 0.7, "archived": 0.5, "superseded": 0.3, "deleted": 0.1}
RANKING = {"text": 0.30, "phrase": 0.15, "confidence": 0.20, "recency": 0.15, "status": 0.10, "meeting": 0.10}

MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
#: Words that a search leaves out.
STOPWORDS = frozenset(
    "a about all an and any are as at be been by did do does during every for from had has have in involved is it later me"
    " of on or related show since so still that the their them there these this those to was we were what when which who"
    " why with you".split()
)

#: Title and advice for each type of insight.
ACTIONS = {
    "repeatedly_superseded_decision": ("Stabilize a repeatedly changed decision", "Hold a focused review to finalize this decision and record the rationale."),
    "revisited_decision": ("Settle a repeatedly revisited decision", "Assign a clear owner and close the topic with a documented outcome."),
    "long_running_decision": ("Close out a long-running decision", "Set a decision deadline to stop the lineage from dragging on."),
    "unstable_decisions": ("Improve overall decision stability", "Review how decisions are made and recorded to reduce churn."),
    "open_commitment_overload": ("Rebalance an overloaded owner", "Redistribute or de-scope commitments to relieve the bottleneck."),
    "overdue_commitment": ("Follow up on an overdue commitment", "Confirm a new due date or re-assign the work."),
    "aging_commitment": ("Review an aging commitment", "Check whether the commitment is still relevant and set a due date."),
    "low_commitment_resolution": ("Improve commitment follow-through", "Track commitments to completion in each meeting's review."),
    "recurring_risk": ("Mitigate a recurring risk", "Create an owned mitigation plan so the risk stops resurfacing."),
    "unresolved_risk": ("Resolve a long-standing risk", "Escalate the risk and assign an owner with a resolution target."),
    "long_lived_risk": ("Address a persistent risk", "Re-evaluate the mitigation; the current approach is not closing it."),
    "risk_hotspot": ("Reduce risk concentration on a project", "Run a risk review for this project to address clustered risks."),
    "project_blocker": ("Unblock a project", "Prioritize clearing the recurring blockers on this project."),
}
#: The order of severities, and the priority that each gives.
SEVERITIES = {"info": 0, "low": 1, "medium": 2, "high": 3, "critical": 4}
PRIORITIES = {"critical": "urgent", "high": "high", "medium": "medium", "low": "low", "info": "low"}
