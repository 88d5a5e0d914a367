"""Short word lists for the queries alone, made to meet words of the test tables; callers give theirs as `sources.lists.Lists`."""

STOP = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with",
    "de", "la", "le", "les", "des", "et", "un", "en", "du", "que", "der", "die", "das", "und", "den", "von", "el", "los", "las", "y", "su",
)
POSITIVE = ("good", "great", "love", "excellent", "happy", "best", "kind", "for", "with")
NEGATIVE = ("bad", "idiot", "moron", "pathetic", "scum", "stupid", "worthless", "loser", "trash", "disgusting", "clown", "at")
MALE_NAMES = ("john", "paul", "peter", "thomas", "the", "den")
FEMALE_NAMES = ("anna", "mary", "lucy", "of", "die")
