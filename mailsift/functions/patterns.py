"""Fixed values.

Everything in this module must equal the behaviour being matched: signal
names and weights, regular expressions, word lists, taxonomy and zone tables.
Patterns are written without engine flags; ``spark_re`` adds the Java flags
and the SQL oracles add the RE2 flags, so both engines run the same text.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES: gate signals in evaluation order, weight in hundredths.
# ---------------------------------------------------------------------------
SIGNALS = [
    ("list_unsubscribe_header", 35),
    ("precedence_bulk", 30),
    ("auto_submitted", 30),
    ("noreply_sender", 25),
    ("marketing_sender", 20),
    ("bulk_sender_name", 15),
    ("reply_to_mismatch", 10),
    ("bcc_recipient", 10),
    ("unsubscribe_body", 30),
    ("view_in_browser", 20),
    ("footer_pattern", 15),
    ("tracking_pixels", 15),
    ("utm_params", 15),
    ("high_html_ratio", 10),
    ("personal_reply", -40),
    ("direct_questions", -15),
]
WEIGHTS = dict(SIGNALS)

# FIXED VALUES: header values for the precedence signal.
BULK_PRECEDENCE = ["bulk", "list", "junk"]

# FIXED VALUES: newsletter words for the spam sub-action (plain substrings).
NEWSLETTER_TERMS = ["newsletter", "digest", "weekly update", "daily brief", "roundup", "edition"]

# ---------------------------------------------------------------------------
# FIXED VALUES: regular expressions (case-insensitive unless noted).
# ---------------------------------------------------------------------------
NOREPLY_RE = (r"^(no[-_.]?reply|do[-_.]?not[-_.]?reply|mailer[-_.]?daemon|postmaster|bounce[s]?"
              r"|auto[-_.]?notify|notifications?|alerts?)@")
MARKETING_SENDER_RE = (r"^(marketing|promotions?|newsletters?|offers?|deals|info|hello|team|support"
                       r"|updates?|news|digest|communications?|campaigns?)@")
BULK_SENDER_NAME_RE = (r"\b(newsletter|digest|weekly\s+update|daily\s+brief|marketing|promotions?"
                       r"|no[-\s]?reply)\b")
UNSUBSCRIBE_BODY_RE = (
    r"\b(unsubscribe|opt[\s-]?out|manage\s+(?:your\s+)?(?:email\s+)?preferences"
    r"|update\s+(?:your\s+)?(?:email\s+)?preferences|change\s+(?:your\s+)?preferences"
    r"|edit\s+preferences|update\s+subscription|notification\s+settings|email\s+settings"
    r"|communication\s+preferences|mailing\s+list|stop\s+receiving|remove\s+(?:me|yourself)\s+from"
    r"|no\s+longer\s+wish\s+to\s+receive"
    r"|(?:you\s+are|you're)\s+receiving\s+this\s+(?:email|message\s+)?because"
    r"|receiving\s+this\s+because\s+you\s+subscribed"
    r"|sent\s+(?:to|because)\s+you(?:'re|\s+are)\s+(?:a\s+)?(?:subscribed|registered|member|on\s+our\s+list))\b")
VIEW_IN_BROWSER_RE = (
    r"\b(view\s+(?:in|this\s+email\s+in)\s+(?:your\s+)?(?:browser|web)"
    r"|view\s+as\s+(?:a\s+)?web\s*page|view\s+(?:the\s+)?online\s+version"
    r"|having\s+trouble\s+(?:viewing|reading)\s+this|can(?:'t|not)\s+(?:see|view|read)\s+this\s+email"
    r"|email\s+not\s+displaying\s+(?:correctly|properly))\b")
FOOTER_RE = (
    r"(?:\d{1,5}\s+\w+\s+(?:street|st|avenue|ave|boulevard|blvd|road|rd|drive|dr|lane|ln|way|suite|ste)[\s,]+"
    r"|©\s*\d{4}|copyright\s*\d{4}|all\s+rights\s+reserved"
    r"|you\s+(?:are\s+)?receiving\s+this\s+(?:email|message)\s+because)")
TRACKING_PIXEL_RE = (
    r"""<img[^>]+(?:width\s*=\s*["']?1["'\s>]|height\s*=\s*["']?1["'\s>]"""
    r"""|style\s*=\s*["'][^"']*(?:width|height)\s*:\s*1px)""")
UTM_RE = r"[?&]utm_(?:source|medium|campaign|content|term)="
# multiline: ^ matches at every line start
PERSONAL_REPLY_RE = (r"(?:^(?:hi|hey|hello|dear|thanks|thank\s+you)\s+\w+"
                     r"|(?:let\s+me\s+know|what\s+do\s+you\s+think|could\s+you|can\s+you|would\s+you))")
QUESTION_RE = (
    r"\b(?:can\s+you|could\s+you|would\s+you|will\s+you|do\s+you|are\s+you|have\s+you"
    r"|what\s+(?:do|does|did|is|are|should|would|could)|when\s+(?:can|will|should|is|are)"
    r"|how\s+(?:do|does|can|should|would)|shall\s+(?:we|i))\b.*\?")

URL_RE = r"\bhttps?://[^\s<>()]+"
MONEY_RE = (r"(?:(?:\$|USD\s?)\s?\d{1,3}(?:,\d{3})*(?:\.\d{2})?"
            r"|\d{1,3}(?:,\d{3})*(?:\.\d{2})?\s?(?:USD|dollars))")
TIME_PHRASE_RE = (
    r"\b(asap|eod|end\s+of\s+day|by\s+\w+(?:\s+\d{1,2})?|due\s+by\s+[^\n\.]+|due\s+on\s+[^\n\.]+"
    r"|tomorrow|today|next\s+week|this\s+week|within\s+\d+\s+(?:hours?|days?)"
    r"|in\s+\d+\s+(?:hours?|days?))\b")
UNSUBSCRIBE_RE = (
    r"\b(unsubscribe|subscribe|change\s+your\s+preferences|change\s+preferences|edit\s+preferences"
    r"|update\s+subscription|update\s+preferences|opt[\s-]?out|manage\s+(?:email\s+)?preferences"
    r"|notification\s+settings|mailing\s+list)\b")

TIME_12H_RE = r"\b(\d{1,2})(?::(\d{2}))?\s*(am|pm)\b"
TIME_24H_RE = r"\b(\d{1,2}):(\d{2})\b"

# FIXED VALUES: limits and suffixes.
TIME_PHRASE_LIMIT = 10
LINK_LIMIT = 10
MONEY_LIMIT = 10
EVIDENCE_LIMIT = 3
EVIDENCE_CHARS = 240
ERROR_CHARS = 500
SNIPPET_CHARS = 180
TRUNCATED_SUFFIX = "\n...[truncated]"
LEGACY_TRUNCATED_SUFFIX = "\n\n[TRUNCATED]"
THREAD_SEPARATOR = "\n\n---\n\n"
SPAM_REASON_GATE = "Automated/subscription email — no action required."
SPAM_REASON_MODEL = "Automated subscription email — no action required."
SPAM_SUCCESS_CRITERIA = "Archive or unsubscribe. No response needed."

# FIXED VALUES: zone words in table order, then offsets (hours) to zone names.
ZONE_WORDS = [
    ("pt", "America/Los_Angeles"), ("pst", "America/Los_Angeles"), ("pdt", "America/Los_Angeles"),
    ("mt", "America/Denver"), ("mst", "America/Denver"), ("mdt", "America/Denver"),
    ("ct", "America/Chicago"), ("cst", "America/Chicago"), ("cdt", "America/Chicago"),
    ("et", "America/New_York"), ("est", "America/New_York"), ("edt", "America/New_York"),
    ("utc", "UTC"), ("gmt", "UTC"),
]
OFFSET_ZONES = [(-8, "America/Los_Angeles"), (-7, "America/Los_Angeles"), (-6, "America/Chicago"),
                (-5, "America/New_York"), (0, "UTC")]

# FIXED VALUES: zone names of Date headers, in minutes from UTC.
DATE_ZONES = {"GMT": 0, "UTC": 0, "UT": 0, "Z": 0, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420,
              "MDT": -360, "PST": -480, "PDT": -420}

# FIXED VALUES: weekday names, Monday first (scan order).
WEEKDAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]

# FIXED VALUES: urgency / priority / action-kind domains.
URGENCY_LEVELS = ["low", "medium", "high", "critical"]
ACTION_KINDS = ["PRIMARY", "SECONDARY", "DANGER"]
TASK_STATUSES = ["open", "done", "snoozed", "cancelled"]

# FIXED VALUES: category taxonomy and recommended sub-action keys.
TAXONOMY = [
    ("core_communication", ["COMM_REPLY_REQUIRED", "COMM_CLARIFICATION_REQUEST", "COMM_STATUS_UPDATE_RESPONSE"]),
    ("decisions_and_approvals", ["DECISION_APPROVE_REJECT", "DECISION_CHOOSE_OPTION", "DECISION_CONFIRM_OUTCOME"]),
    ("schedule_and_time", ["SCHEDULE_PROPOSE_TIME", "SCHEDULE_CONFIRM_TIME", "SCHEDULE_RESCHEDULE",
                           "SCHEDULE_RSVP", "SCHEDULE_ADD_CALENDAR_BLOCK", "SCHEDULE_DEADLINE_CONFIRM"]),
    ("documents_and_review", ["DOC_REVIEW_REQUEST", "DOC_COMMENT_REQUEST", "DOC_SIGNOFF_REQUEST"]),
    ("financial_and_admin", ["FINANCE_PAY_INVOICE", "FINANCE_APPROVE_EXPENSE", "FINANCE_UPDATE_BILLING",
                             "FINANCE_RENEW_CANCEL"]),
    ("people_and_process", ["PROCESS_HANDOFF", "PROCESS_OWNERSHIP_CHANGE", "PROCESS_WORKFLOW_UPDATE"]),
    ("information_and_org", ["INFO_FYI", "INFO_STATUS_REPORT", "INFO_ANNOUNCEMENT"]),
    ("learning_and_awareness", ["LEARN_ARTICLE", "LEARN_WEBINAR", "LEARN_COURSE"]),
    ("social_and_people", ["SOCIAL_INTRO", "SOCIAL_INVITE", "SOCIAL_CONGRATS"]),
    ("meta_and_systems", ["SYSTEM_ALERT", "SYSTEM_SECURITY", "SYSTEM_NOTIFICATION"]),
    ("spam", ["SPAM_UNSUBSCRIBE", "SPAM_NEWSLETTER", "SPAM_MARKETING"]),
    ("other", ["OTHER"]),
]
CATEGORIES = [c for c, _ in TAXONOMY]


def spark_re(pattern: str, multiline: bool = False) -> str:
    """Java flags: case-insensitive; ``(?d)`` so ``.`` stops only at LF as in
    the matched behaviour and in RE2; ``(?U)`` for Unicode words and spaces."""
    return ("(?idmU)" if multiline else "(?idU)") + pattern


def sql_re(pattern: str, multiline: bool = False) -> str:
    """RE2 flags for the DuckDB oracles; RE2's own ``\\w`` is ASCII only."""
    return ("(?im)" if multiline else "(?i)") + pattern.replace(r"\w", r"[\pL\pN_]")


def sql_str(s: str) -> str:
    """Quote a Python string as a standard SQL literal."""
    return "'" + s.replace("'", "''") + "'"
