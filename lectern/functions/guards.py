"""Literals that a pattern cannot match without: a cheap test before the pattern itself."""

from __future__ import annotations

import re
import re._constants as C
import re._parser as parser
import warnings

#: A guard of more literals than this, or with a shorter one, saves too little.
MOST, LEAST = 400, 3


def _best(options: list[frozenset[str] | None]) -> frozenset[str] | None:
    """The option that is likely to occur least: its shortest literal is longest, then fewest literals."""
    real = [o for o in options if o]
    return max(real, key=lambda o: (min(map(len, o)), -len(o)), default=None)


def _need(tree) -> frozenset[str] | None:
    options: list[frozenset[str] | None] = []
    run = ""
    for op, arg in tree:
        if op is C.LITERAL and arg < 128 and arg != 10:
            run += chr(arg).lower()
            continue
        if run:
            options.append(frozenset((run,)))
        run = ""
        if op is C.BRANCH:
            parts = [_need(b) for b in arg[1]]
            options.append(None if any(p is None for p in parts) else frozenset().union(*parts))
        elif op is C.SUBPATTERN:
            options.append(_need(arg[3]))
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0] >= 1:
            options.append(_need(arg[2]))
        elif op is C.LITERAL:
            options.append(frozenset((chr(arg),)))
    if run:
        options.append(frozenset((run,)))
    return _best(options)


def literals(pattern: str) -> list[str] | None:
    """Lower-case literals one of which every match contains; None if there is no useful set."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        got = _need(parser.parse(pattern))
    if not got or len(got) > MOST or min(len(x.encode()) for x in got) < LEAST:
        return None
    # a literal that contains another is implied by it
    return sorted(x for x in got if not any(y != x and y in x for y in got))


def _tree(tree) -> tuple | None:
    parts: list[tuple] = []
    run = ""

    def close() -> None:
        nonlocal run
        if len(run) >= LEAST and run.isascii():
            parts.append(("lit", run))
        elif run and not any(x.isalnum() or x in " .,'" for x in run):
            parts.append(("sign", run))
        run = ""

    for op, arg in tree:
        if op is C.LITERAL and arg != 10 and (arg < 128 or not chr(arg).isalpha()):
            run += chr(arg).lower()
            continue
        close()
        if op is C.BRANCH:
            some = [_tree(b) for b in arg[1]]
            if all(some):
                parts.append(("or", *dict.fromkeys(some)))
        elif op in (C.SUBPATTERN, C.ATOMIC_GROUP):
            parts.append(_tree(arg[3] if op is C.SUBPATTERN else arg))
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT) and arg[0] >= 1:
            parts.append(_tree(arg[2]))
        elif op is C.ASSERT:
            parts.append(_tree(arg[1]))
        elif op is C.IN and all(o is C.LITERAL and not (chr(a).isalnum() or chr(a) in " .,'\n\t") for o, a in arg):
            parts.append(("or", *(("sign", chr(a)) for _, a in arg)))
    close()
    parts = list(dict.fromkeys(x for x in parts if x))
    return ("and", *parts) if len(parts) > 1 else parts[0] if parts else None


def needed(pattern: str) -> tuple | None:
    """What a text with a match has: ("lit", lower-case word or phrase), ("sign", marks), ("and", ...), ("or", ...); None if nothing is known.

    Unlike ``literals`` it names every part of an alternative, so that a rare word beside a frequent one counts.
    """
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return _tree(parser.parse(pattern))


def only(kind: str, tree: tuple | None) -> tuple | None:
    """The tree with atoms of this kind alone: weaker, still needed."""
    if tree is None or tree[0] in ("lit", "sign"):
        return tree if tree and tree[0] == kind else None
    parts = [only(kind, x) for x in tree[1:]]
    if tree[0] == "or":
        return ("or", *dict.fromkeys(parts)) if all(parts) else None
    parts = list(dict.fromkeys(x for x in parts if x))
    return ("and", *parts) if len(parts) > 1 else parts[0] if parts else None


#: Words that stand in most texts.
COMMON = frozenset("a an and are as at be been but by can do for from had has have he her his if in into is it its more most my no not of on or our out so than that the their then there these they this to up was we were what when which who will with you your".split())


def cost(word: str) -> float:
    """About how often a literal occurs: short ones and those of frequent words alone do most."""
    n = len(word.split())
    often = {1: 50.0, 2: 5.0}.get(n, 0.5) if all(w in COMMON for w in word.split()) else 0.0
    return max(often, {3: 8.0, 4: 3.0, 5: 1.0}.get(len(word.strip()), 0.3 if len(word.strip()) > 5 else 50.0))


def rarest(tree: tuple) -> frozenset[str]:
    """Atoms one of which is there wherever all that is needed is: of parts that are all needed, those that should occur least."""
    if tree[0] in ("lit", "sign"):
        return frozenset((tree[1],))
    sets = [rarest(x) for x in tree[1:]]
    return frozenset().union(*sets) if tree[0] == "or" else min(sets, key=lambda o: sum(map(cost, o)))


_ENDS = {C.CATEGORY_SPACE, C.CATEGORY_NOT_WORD, C.CATEGORY_NOT_DIGIT}


def _crosses(tree) -> bool:
    for op, arg in tree:
        if op is C.LITERAL:
            hit = arg == 10
        elif op is C.NOT_LITERAL:
            hit = arg != 10
        elif op is C.IN:
            held = any(a == 10 if o is C.LITERAL else a[0] <= 10 <= a[1] if o is C.RANGE else a in _ENDS if o is C.CATEGORY else False for o, a in arg)
            hit = held != (arg[0][0] is C.NEGATE)
        elif op is C.AT:
            hit = arg in (C.AT_BEGINNING_STRING, C.AT_END_STRING)
        elif op is C.BRANCH:
            hit = any(map(_crosses, arg[1]))
        elif op is C.SUBPATTERN:
            hit = bool(arg[1] & re.S) or _crosses(arg[3])
        elif op is C.ATOMIC_GROUP:
            hit = _crosses(arg)
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
            hit = _crosses(arg[2])
        elif op in (C.ASSERT, C.ASSERT_NOT):
            hit = _crosses(arg[1])
        else:  # any character but line feeds, or a group again, which holds none if nothing else does
            hit = op not in (C.ANY, C.GROUPREF)
        if hit:
            return True
    return False


def within_line(pattern: str) -> bool:
    """Whether the pattern can neither match nor look at a line feed, so that its matches in a text are those in its lines."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        tree = parser.parse(pattern)
    return not tree.state.flags & re.S and not _crosses(tree)


def trie(words: list[str]) -> str:
    """A pattern for the longest of the words at a place. Words that begin alike share a branch, so a place costs a few comparisons however many there are."""
    tree: dict = {}
    for w in words:
        at = tree
        for c in w:
            at = at.setdefault(c, {})
        at[""] = {}

    def pattern(t: dict) -> str:
        run = ""
        while len(t) == 1 and "" not in t:
            (c, t), = t.items()
            run += re.escape(c)
        rest = [(c, re.escape(c) + pattern(x)) for c, x in sorted(t.items()) if c]
        if not rest:
            return run
        return run + "(?:" + halves(rest) + ")" + ("?" if "" in t else "")

    def halves(rest: list[tuple[str, str]]) -> str:
        """Branches behind a look at the next character: a few tests instead of one a branch."""
        if len(rest) <= 3:
            return "|".join(x for _, x in rest)
        a, b = rest[: len(rest) // 2], rest[len(rest) // 2 :]
        return "|".join(f"(?=[{''.join(re.escape(c) for c, _ in x)}])(?:{halves(x)})" for x in (a, b))

    return pattern(tree)


def covered(words: list[str], all_words: list[str]) -> list[str]:
    """The words of ``all_words`` that begin with one of ``words``: where one of those is the longest at a place, one of these is there too."""
    return sorted(x for x in all_words if x.startswith(tuple(words)))
