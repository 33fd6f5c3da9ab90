"""Word lists, patterns and constants of the metrics."""

# Lists, patterns and thresholds that results depend on.

MARKERS = {"oh": r"\boh\b", "okay": r"\b(?:okay|ok)\b", "uh_huh": r"\buh-?\s?huh\b"}

SYCOPHANCY_OPENERS = (
    "absolutely", "definitely", "exactly", "for sure", "great point",
    "i couldn't agree more", "i completely agree", "totally",
)

BACKCHANNEL_PRESENCE = r"\b(uh-?huh|okay|ok|mm-?hm)\b"
BACKCHANNEL_FULL = r"^\s*(uh-?huh|okay|ok|mm-?hm|yeah|right|sure)[\s.,!?]*$"

REPAIR_REPEAT = r"\b(\w+)\s+\1\b"
REPAIR_MARKER = r"-\s|I mean\b|or rather\b"

CLOSING_STAGES = (
    r"\bokay\b|\ball right\b|\bwell\b",
    r"\bi (should|have to|need to|gotta) go\b",
    r"\bhave a (nice|good|great)\b|\btake care\b|\bgood luck\b",
    r"\bbye\b|\bgoodbye\b|\bsee you\b|\bsee ya\b",
)

SYCOPHANCY_PHRASES = (
    "that's a great point", "i really agree", "absolutely",
    "you're right that", "great question", "i love that",
    "that's a really good point", "i completely agree",
    "that's so true", "i totally agree", "great point",
    "definitely", "exactly right",
)

STOP_WORDS = (
    "a", "an", "the", "and", "or", "but", "in", "on", "at", "to",
    "for", "of", "with", "is", "it", "i", "you", "he", "she", "we",
    "they", "was", "are", "be", "been", "being", "have", "has", "had",
    "do", "does", "did", "will", "would", "could", "should", "may",
    "might", "that", "this", "these", "those", "my", "your", "his",
    "her", "our", "their", "its", "not", "no", "so", "as", "if",
    "up", "out", "about", "just", "like", "what", "when", "how",
    "there", "then", "than", "from", "by", "into", "over", "also",
)

TASK = (
    r"\byou should\b", r"\byou could\b", r"\byou need to\b", r"\btry to\b",
    r"\btry\b.+\b(?:doing|using|making|calling|asking)\b", r"\bi recommend\b", r"\bmy recommendation\b",
    r"\bthe best (?:way|option|approach|solution)\b", r"\bhere are\b", r"\bsteps?\b", r"\bsolution\b",
    r"\bconsider\b", r"\bmake sure\b",
)
EXPLANATION = (
    r"\bthere are (?:several|many|a few|three|two)\b", r"\bit is important to\b", r"\bit's important to\b",
    r"\boverall\b", r"\bin conclusion\b", r"\bto summarize\b", r"\bthis can be (?:understood|explained)\b",
    r"\bmany people\b", r"\bin general\b", r"\bgenerally speaking\b", r"\b(?:first|second|third|finally),\b",
    r"^\s*\d+[\).\s]", r"\bas an ai\b",
)
EXPLANATION_LONG, EXPLANATION_LONG_WORDS = r"\b(?:because|therefore|however|for example)\b", 45
PHATIC = (
    r"\boh wow\b", r"\bwow\b", r"\bthat's funny\b", r"\bthat is funny\b", r"\bno kidding\b", r"\bsame here\b",
    r"\bi know\b", r"\bexactly\b", r"\bright\b", r"\byeah\b", r"\bhaha\b", r"\blaugh",
)
BACKCHANNEL = (
    r"^(?:uh-?huh|mm-?hm|mhm|yeah|right|okay|ok|i see|sure|exactly|oh|wow)[.!?,\s]*$",
    r"^(?:yeah|right|okay|ok|uh-?huh|mm-?hm),?\s+(?:yeah|right|okay|ok|uh-?huh)[.!?,\s]*$",
)
BACKCHANNEL_SHORT, BACKCHANNEL_SHORT_WORDS = r"\b(?:yeah|right|okay|ok|uh-?huh|i see)\b", 4
PERSONAL = (
    r"\bi (?:think|feel|guess|remember|like|love|hate|prefer|used to|had|have|was|am)\b", r"\bi've\b", r"\bi'd\b",
    r"\bmy (?:mom|dad|mother|father|brother|sister|family|friend|friends|wife|husband|kids|job|school|house|car)\b",
    r"\bfor me\b", r"\bwhen i\b", r"\bwhere i\b", r"\bwe (?:had|have|used to|were|are|went|did)\b",
)
REPAIR = (
    r"\bwhat do you mean\b", r"\bwhat d'you mean\b", r"\bwait\b", r"\bsorry\b", r"\bi mean\b", r"\byou mean\b",
    r"\bwhich one\b", r"\bsay that again\b", r"\bpardon\b", r"\bclarif", r"\bno,? i meant\b",
)
RECIPROCAL = (
    r"\bwhat about you\b", r"\bhow about you\b", r"\bdid you\b", r"\bdo you\b", r"\bhave you\b",
    r"\bwhat kind\b", r"\bwhere do you\b", r"\bhow do you\b",
)
TOPIC_MAINTAIN, TOPIC_SHIFT = 0.22, 0.07

DRIFT_WORDS = ("el", "la", "que", "de", "en", "es", "con", "para", "una", "los", "las", "del", "pero", "como", "muy", "nuestra")
DRIFT_WORDS_TEST = ("el", "la", "que", "de", "en", "es", "con", "clima", "acuerdo", "cambio", "todo", "nuestra", "para", "una", "los", "las", "del")
DRIFT_WORDS_FINAL = ("el", "la", "que", "de", "en", "es", "con", "para", "una", "los", "las", "del", "pero", "como", "muy")
DRIFT_HITS = 4
LEAK = r"\bparticip\w*[\s_]*[ab]?\s*[:,]|\bpart[ab]\b"
LEAK_TEST = r"\bpart(?:ner|icipant)"
TELLS = (
    r"how can i help|how may i help|is this the|i'd be happy to help|i can help you|"
    r"i recommend|i would recommend|you should|you could try|here are (?:a few|some|three)|"
    r"feel free to|don't hesitate|as an ai|hope this helps|glad i could help|happy to assist"
)
CLOSING = (
    r"\b(?:good-?bye|bye-?bye|bye|take care|farewell|see you(?: around| soon| later| next time)?|"
    r"talk (?:to you )?(?:soon|later)|catch you later|until next time|happy chatting|"
    r"(?:nice|great|lovely|a pleasure) (?:talking|chatting|speaking)(?: (?:to|with) you)?|"
    r"enjoy (?:the rest of )?your day|"
    r"have a (?:great|good|nice|wonderful|lovely|fantastic) (?:day|one|time|evening|weekend))\b"
)
STRICT_LINE = r"^(Participant[AB])\s*:\s*(.*)"
TOLERANT_LINE = r"^\s*(Particip\w*\s*[ab])\s*:\s*(.*)"
MARKUP_NOTE, MARKUP_OPENING, MARKUP_BRACKETS, MARKUP_END, SPACE_BEFORE_MARK = r"<+[^>]*>+", r"\{[A-Z]\s", "}[]+#", "-?/", r"\s+([,.?!])"
LEAD_LABEL = r"(?:particip\w*|part(?:ner)?|user|assist\w*|human|ai|system|bot)[\s_]*[ab]?\s*[:,]\s*"
INNER_LABEL = r"(?:\b(?:ParticipantA|ParticipantB|Participants?\s*[AB])\s*:)|(?:(?:^|\n)\s*(?:USER|ASSIST\w*|HUMAN|AI|SYSTEM|BOT)\s*:)"
RESIDUE = (
    r"(?:\[(?:end of|turn|tur|t\b|this|do you|assist|closed|/)"
    r"|\*{1,}\s*(?:conversation|chat|session|closed|ended|assistance|connection|end of)"
    r"|here'?s (?:the |a )?(?:quick )?(?:summary|recap)"
    r"|this (?:concludes|conversation (?:covered|concludes|ends))"
    r"|```"
    r"|(?:^|\n)\s*(?:USER|ASSISTANT|ASSISTMENT|SYSTEM|BOT)\b"
    r"|\*\*\s*\||\|\s*->|->\s*\||\bV\s+V\s+V\b"
    r"|(?:^|\n)\s*---\s*(?:$|\n))"
)
EDUCATION = {
    "0": "less than a high-school education", "1": "a high-school education", "2": "some college",
    "3": "a college degree", "9": "an unspecified education",
}
DEFAULT_AGE = 40


def any_of(patterns) -> str:
    """One alternation, so that a list costs one scan of a text."""
    return "|".join(f"(?:{p})" for p in patterns)


def words(ws) -> str:
    return r"\b(?:" + "|".join(ws) + r")\b"
