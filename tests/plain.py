"""Similar titles from the rule, in whole numbers: shared by the tests of titles and of the selection."""

import re


def title_words(title):
    return frozenset(re.findall(r"\w+", title.lower()))


def alike(a, b):
    """More than half of the smaller set is shared; an empty set is like nothing."""
    return 2 * len(a & b) > min(len(a), len(b))


def displaced(ranked):
    """{key: key of the first kept title that is alike, or None} for (key, title) in rank order."""
    kept, found = [], {}
    for key, title in ranked:
        own = title_words(title)
        found[key] = next((k for k, words in kept if alike(words, own)), None)
        if found[key] is None:
            kept.append((key, own))
    return found
