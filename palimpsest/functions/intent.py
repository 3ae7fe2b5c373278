"""Question intent, recency hints and abstention, by tables of patterns.

Word boundaries are written as look-arounds over ASCII, since Java's ``\\b``
also counts other letters. ``sql_pattern`` gives the ``\\b`` form back.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns of each class, in order; (?i) marks those that ignore case.
TEMPORAL = [
    r"(?i)\bwhen\b",
    r"(?i)\blast\s+(met|meeting|call|conversation|chat|talked|spoke|seen|heard|time)\b",
    r"(?i)\brecent(ly)?\b",
    r"(?i)\bhistory\b",
    r"(?i)\btimeline\b",
    r"(?i)\bmeeting\s+notes?\b",
    r"(?i)\bwhat('s| is| was)\s+new\b",
    r"(?i)\blatest\b",
    r"(?i)\bupdate(s)?\s+(on|from|about)\b",
    r"(?i)\bhow\s+long\s+(ago|since)\b",
    r"(?i)\b\d{4}[-/]\d{2}\b",
    r"(?i)\blast\s+(week|month|quarter|year)\b",
]
EVENT = [
    r"(?i)\bannounce[ds]?(ment)?\b",
    r"(?i)\blaunch(ed|es|ing)?\b",
    r"(?i)\braised?\s+\$?\d",
    r"(?i)\bfund(ing|raise)\b",
    r"(?i)\bIPO\b",
    r"(?i)\bacquisition\b",
    r"(?i)\bmerge[drs]?\b",
    r"(?i)\bnews\b",
    r"(?i)\bhappened?\b",
]
ENTITY = [
    r"(?i)\bwho\s+is\b",
    r"(?i)\bwhat\s+(is|does|are)\b",
    r"(?i)\btell\s+me\s+about\b",
    r"(?i)\bdescribe\b",
    r"(?i)\bsummar(y|ize)\b",
    r"(?i)\boverview\b",
    r"(?i)\bbackground\b",
    r"(?i)\bprofile\b",
    r"(?i)\bwhat\s+do\s+(i|you|we)\s+know\b",
]
FULL_CONTEXT = [
    r"(?i)\beverything\b",
    r"(?i)\ball\s+(about|info|information|details)\b",
    r"(?i)\bfull\s+(history|context|picture|story|details)\b",
    r"(?i)\bcomprehensive\b",
    r"(?i)\bdeep\s+dive\b",
    r"(?i)\bgive\s+me\s+everything\b",
]
CANONICAL = [
    r"(?i)\bwho\s+is\b",
    r"(?i)\bwhat\s+(is|are|does|means?)\b",
    r"(?i)\bdefin(e|ition|ing)\b",
    r"(?i)\bexplain\s+(what|how|why)\b",
    r"(?i)\b(history|origin|background)\s+of\b",
    r"(?i)\bconcept\s+of\b",
    r"(?i)\boverview\s+of\b",
    r"(?i)\btell\s+me\s+about\b",
    r"(?i)\bcompiled\s+truth\b",
    r"::|->|\.\w+\(",
    r"(?i)\b(function|class|method|module)\s+\w+",
    r"(?i)\b(graph|traversal|backlinks?|inbound|outbound)\b",
]
STRONG_RECENCY = [
    r"(?i)\btoday\b",
    r"(?i)\bright\s+now\b",
    r"(?i)\bthis\s+morning\b",
    r"(?i)\bjust\s+now\b",
]
RECENCY_ON = [
    r"(?i)\bwhat'?s\s+(going\s+on|happening|new|latest|up)\b",
    r"(?i)\b(latest|recent(ly)?|currently)\b",
    r"(?i)\b(this|last|past)\s+(week|month|few\s+days|couple\s+days)\b",
    r"(?i)\bmeeting\s+(prep|with|for|notes?|brief)\b",
    r"(?i)\bbefore\s+(my|the|our)\s+(meeting|call|sync|chat)\b",
    r"(?i)\bprep(are)?\s+(for|me)\b",
    r"(?i)\bcatch(es|ing)?\b[\s\w]{0,15}\bup\b",
    r"(?i)\bremind\s+me\s+(what|about|of)\b",
    r"(?i)\b(update|status|progress)\s+(on|with|from)\b",
]
TIME_BOUND = [
    r"(?i)\btoday\b",
    r"(?i)\bright\s+now\b",
    r"(?i)\bthis\s+morning\b",
    r"(?i)\bthis\s+week\b",
    r"(?i)\bsince\s+(launch|last|the|\d)",
    r"(?i)\blast\s+\d+\s+(day|days|week|weeks|month|months)\b",
]
CONCEPT_CUE = [
    r"(?i)\b(all|every)\b.+\b(that|who|which|doing|with|about|related to)\b",
    r"(?i)\b(find|list|show)\s+(all|every|everything)\b",
    r"(?i)\beverything\s+(about|on|matching|related)\b",
    r"(?i)\bthe\s+(landscape|ecosystem|space|universe)\s+of\b",
    r"(?i)\b(landscape|ecosystem)\s+(of|around)\b",
    r"(?i)\bwhich\s+\w+[\w\s]*\b(do|does|are|have|use|work)\b",
]
CONCEPT_ASKED = [
    r"\b[Ww]hat\s+(is|are)\s+(the\s+)?[a-z][\w'’-]*\s+[a-z]",
    r"\b[Ww]hat\s+do\s+(i|you|we)\s+know\s+about\s+[a-z][\w'’-]*\s+[a-z]",
    r"(?i)\b(notes|ideas|thinking|thoughts|writing)\s+(on|about)\b",
    r"(?i)\bways\s+to\b",
    r"(?i)\bhow\s+to\s+think\s+about\b",
    r"(?i)\bconcept\s+of\b",
]
CONCEPT_STATUS = [
    r"(?i)\b(working on|up to|doing|saying|talking about|focused on|meeting with)\b",
]
CONCEPT_NOT = [
    r"""["'“”][^"'“”]+["'“”]""",
    r"\b[a-z0-9]+(?:-[a-z0-9]+){1,}\b",
]
ABSTENTION = [
    r"(?i)\b(does|do|did)\s+not\s+contain\b",
    r"(?i)\b(doesn't|don't|didn't)\s+contain\b",
    r"(?i)\bnot\s+enough\s+information\b",
    r"(?i)\binsufficient\s+(information|evidence|context)\b",
    r"(?i)\bno\s+(information|evidence|mention|reference)\b",
    r"(?i)\b(cannot|can't|could not|couldn't|unable to)\s+(answer|determine|find|be\s+determined)\b",
    r"(?i)\bnot\s+(stated|specified|mentioned|provided|available|present)\b",
    r"(?i)\bevidence\s+(provided\s+)?does\s+not\b",
    r"(?i)\bis\s+not\s+in\s+the\s+(evidence|documents?|provided)\b",
]
ASSERTION = [
    r"(?i)\b(but|however|although|though)\b",
    r"(?i)\bbased\s+on\b",
    r"(?i)\bit\s+(may|might|could|would)\s+be\b",
    r"(?i)\b(suggests?|implies|indicates?|appears?\s+to\s+be)\b",
    r"(?i)\bthe\s+(closest|best|most\s+likely)\b",
]

#: Keyword weight, vector weight, recency hint and exact-match boost of each intent.
INTENT_WEIGHTS = {"entity": (1.15, 1.0, None, 1.25), "temporal": (1.0, 1.0, "on", 1.0), "event": (1.2, 0.95, "on", 1.1), "concept": (0.9, 1.2, None, 1.0), "general": (1.0, 1.0, None, 1.0)}


_WORD = "(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"


def _any(patterns: list[str]) -> str:
    """All patterns as one alternation."""
    return "|".join(f"(?i:{p[4:]})" if p.startswith("(?i)") else f"(?:{p})" for p in patterns)


def java_pattern(patterns: list[str]) -> str:
    return _any(patterns).replace(r"\b", _WORD)


def sql_pattern(patterns: list[str]) -> str:
    return _any(patterns).replace("'", "''")


def matches(col: Column, patterns: list[str]) -> Column:
    return col.rlike(java_pattern(patterns))


def concept_shaped(q: Column) -> Column:
    t = F.trim(q)
    cue = matches(t, CONCEPT_CUE)
    asked = matches(t, CONCEPT_ASKED)
    capital = t.rlike(r"[^ \t\n\r.!?:;•\-(\[\"“][ \t\n\r]+\p{Lu}")
    long_enough = F.size(F.split(t, "[ \\t\\n\\r]+")) >= 3
    return long_enough & (cue | asked) & ~matches(t, CONCEPT_NOT) & ~capital & ~(asked & ~cue & matches(t, CONCEPT_STATUS))


def intent(q: Column) -> Column:
    """full context, then temporal, event, concept, entity, general."""
    return F.when(matches(q, FULL_CONTEXT) | matches(q, TEMPORAL), "temporal").when(matches(q, EVENT), "event").when(concept_shaped(q), "concept").when(matches(q, ENTITY), "entity").otherwise("general")


def recency_suppressed(q: Column) -> Column:
    return matches(q, CANONICAL) & ~matches(q, TIME_BOUND)


def recency_hint(q: Column) -> Column:
    return F.when(recency_suppressed(q), "off").when(matches(q, STRONG_RECENCY), "strong").when(matches(q, RECENCY_ON), "on").otherwise("off")


def abstention(answer: Column, citations: Column) -> Column:
    return F.when(~matches(answer, ABSTENTION), "answered").when((F.size(citations) > 0) | matches(answer, ASSERTION), "partial").otherwise("abstained")
