"""The scan of a text as SQL: all recognizers in one pass, in expressions that are parsed once.

Spark parses a text of SQL in one call, where a tree of columns takes a call
to the JVM for each of its nodes; and matches of all recognizers share what
lays them out and judges them. What is grown along an array is grown in runs, and
pieces of a text are cut from blocks of it, so the time follows the number of spans.

Expressions use the columns ``__text``, ``__folded``, ``__places`` and ``__digits`` of ``detect``.
"""

from __future__ import annotations

from sitara.functions.text import _INVISIBLE_CLASS, _MARKS_CLASS, ARABIC_CLASS, CUT, DIGITS_FROM, DIGITS_TO, LETTERS_FROM, LETTERS_TO
from sitara.operators.recognizers import CONTEXT_BOOST, PLACE_BOOST, Recognizer
from sitara.sources.policy import Policy

#: Numbers that are run over one after another; code points of a block of text.
RUN, BLOCK = 128, 512
#: Entities of these name prefixes win ties: they are more specific.
SPECIFIC = ("EG_", "AR_")


def quoted(value: str) -> str:
    """A string as SQL."""
    return "'" + "".join({"\\": "\\\\", "'": "\\'", "\0": "\\0"}.get(c, c) for c in value) + "'"


def strings(values) -> str:
    return f"CAST(array({', '.join(map(quoted, values))}) AS array<string>)"


def let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` for a value that is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def running(numbers: str, largest: bool = False, depth: str = "") -> str:
    """Running sums, or largest values, of an array of whole numbers, each with its own.

    Runs of numbers are gone over apart, then moved by what lies before them,
    so what is copied grows far less than the square of the array's size.
    """
    op = (lambda a, b: f"greatest({a}, {b})") if largest else (lambda a, b: f"{a} + {b}")
    none = "-1" if largest else "0"

    def run(xs: str, at: str) -> str:
        step = op("a.at", "n")
        return f"aggregate({xs}, named_struct('at', {at}, 'out', CAST(array() AS array<int>)), (a, n) -> named_struct('at', {step}, 'out', concat(a.out, array({step}))), a -> a.out)"

    runs = f"transform(sequence(1, size(xs), {RUN}), i -> slice(xs, i, {RUN}))"
    totals = f"transform(rs, r -> aggregate(r, {none}, (a, n) -> {op('a', 'n')}))"
    many = let(runs, "rs", let(run(totals, none), "es", f"flatten(transform(rs, (r, i) -> {run('r', f'coalesce(get(es, i - 1), {none})')}))"))
    return let(numbers, "xs", f"CASE WHEN size(xs) > {RUN} THEN {many} ELSE {run('xs', none)} END")


def fold(text: str) -> str:
    """Gazetteer fold and lower case of text that went through DIGITS already."""
    return f"lower(translate(regexp_replace({text}, {quoted(f'[{_INVISIBLE_CLASS}{_MARKS_CLASS}]')}, ''), {quoted(DIGITS_FROM + LETTERS_FROM)}, {quoted(DIGITS_TO + LETTERS_TO)}))"


def blocks(text: str) -> str:
    return f"regexp_extract_all({text}, '(?s).{{1,{BLOCK}}}', 0)"


def cut(own: str, at: str, n: str) -> str:
    """``n`` (BLOCK at most) code points from place ``at`` on, of a text in blocks."""
    return f"substring(concat(coalesce(get({own}, ({at}) div {BLOCK}), ''), coalesce(get({own}, ({at}) div {BLOCK} + 1), '')), ({at}) % {BLOCK} + 1, {n})"


#: Whether the text has two digits side by side: most have not, and need none of the patterns of numbers.
DIGITS_SIDE_BY_SIDE = "__folded RLIKE '[0-9]{2}'"


def matches(found: list[Recognizer]) -> str:
    """All matches: array of (r, start, end, value), r the recognizer's number, places in the folded text."""
    hits = []
    for k, r in enumerate(found):
        p = quoted(r.pattern)
        guards = [f"contains(__folded, {quoted(r.sign)})"] if r.sign else []
        guards += ["__digits"] if r.digits else []
        guards += [f"__folded RLIKE {quoted(f'(?=[^\\x00-\\x7F])[{ARABIC_CLASS}]')}"] if r.arabic_only else []
        hits.append(f"CASE WHEN {' AND '.join([*guards, f'__folded RLIKE {p}'])} THEN named_struct('r', {k}, 'gaps', split(regexp_replace(__folded, {p}, {quoted(CUT)}), {quoted(CUT)}, -1), 'hits', regexp_extract_all(__folded, {p}, 0)) END")
    pairs = "zip_with(slice(h.gaps, 1, size(h.hits)), h.hits, (g, m) -> named_struct('g', char_length(g), 'm', m, 'n', char_length(m)))"
    laid = let(pairs, "ps", f"zip_with(ps, {running('transform(ps, p -> p.g + p.n)')}, (p, e) -> named_struct('r', h.r, 'start', e - p.n, 'end', e, 'value', p.m))")
    return f"flatten(transform(filter(array({', '.join(hits)}), h -> h IS NOT NULL), h -> {laid}))"


def _of(values: list[str], s: str = "s") -> str:
    """A value by the number of the recognizer."""
    return f"element_at(array({', '.join(values)}), {s}.r + 1)"


def judged(found: list[Recognizer], policy: Policy) -> str:
    """Spans of ``__judged`` (matches with ``base``) in places of the source text, scored, of known entities at their threshold."""
    own = [policy.entities[r.entity] for r in found]
    term = "CAST(NULL AS string)"
    if any(r.terms for r in found):
        window = _of([str(r.window) for r in found])
        before, after = cut("x.folded", "greatest(s.start - w, 0)", "s.start - greatest(s.start - w, 0)"), cut("x.folded", "s.end", "w")
        around = f"concat({fold(before)}, ' \\0 ', {fold(after)})"
        terms = _of([strings(r.terms) for r in found])
        term = let(terms, "ts", f"CASE WHEN size(ts) > 0 THEN {let(window, 'w', let(around, 'a', 'get(filter(ts, t -> contains(a, t)), 0)'))} END")
    places = _of([strings(r.places) for r in found])
    boost = f"CASE WHEN size({places}) > 0 AND {let(fold('s.value'), 'v', f'exists({places}, p -> contains(v, p))')} THEN {PLACE_BOOST}D ELSE 0D END" if any(r.places for r in found) else "0D"
    score = f"least(1D, CASE WHEN c.term IS NOT NULL THEN least(1D, s.base + {CONTEXT_BOOST}D) ELSE s.base END + {boost})"
    first, last = "coalesce(get(__places, s.start), s.start)", "least(coalesce(get(__places, s.end - 1), s.end - 1) + 1, x.length)"
    whole = "substring(__text, o.start + 1, o.end - o.start)"
    value = f"CASE WHEN x.same THEN s.value WHEN o.end - o.start <= {BLOCK} THEN {cut('x.text', 'o.start', 'o.end - o.start')} ELSE {whole} END"
    names = {"entity_type": quoted, "recognizer": quoted, "action": quoted}
    of = {"entity_type": [r.entity for r in found], "recognizer": [r.name for r in found], "action": [e.action for e in own]}
    by_r = {n: _of([names[n](v) for v in vs]) for n, vs in of.items()}
    made = let(f"named_struct('term', {term})", "c", let(f"named_struct('start', CAST({first} AS int), 'end', CAST({last} AS int))", "o", f"named_struct('start', o.start, 'end', o.end, 'entity_type', {by_r['entity_type']}, 'recognizer', {by_r['recognizer']}, 'score', {score}, 'context_term', c.term, 'action', {by_r['action']}, 'value', {value}, 'r', s.r)"))
    kept = "ms"
    if arabic := [str(k) for k, r in enumerate(found) if r.arabic_only]:
        # A span meets an Arabic run if it has an Arabic letter; others are compared with the runs.
        letter, other = rf"[{ARABIC_CLASS}&&\p{{L}}]", rf"[\p{{L}}&&[^{ARABIC_CLASS}]]"
        runs = f"regexp_extract_all(__folded, {quoted(f'{letter}[^{other}]*|{other}[^{letter}]*')}, 0)"
        lead = "x.folded_length - coalesce(get(es, size(es) - 1), 0)"
        placed = let(runs, "rs", let(running("transform(rs, r -> char_length(r))"), "es", f"zip_with(rs, transform(es, (e, i) -> named_struct('start', CASE WHEN i = 0 THEN 0 ELSE {lead} + get(es, i - 1) END, 'end', {lead} + e)), (r, e) -> named_struct('arabic', r RLIKE {quoted(f'^[{ARABIC_CLASS}]')}, 'start', e.start, 'end', e.end))"))
        plain = f"s.r NOT IN ({', '.join(arabic)}) OR s.value RLIKE {quoted(letter)}"
        meets = f"exists(rs, r -> r.arabic AND r.start < s.end AND s.start < r.end)"
        kept = f"CASE WHEN forall(ms, s -> {plain}) THEN ms ELSE {let(placed, 'rs', f'filter(ms, s -> {plain} OR {meets})')} END"
    threshold = _of([f"CAST({e.threshold!r} AS double)" for e in own])
    written = f"array_contains({_of([strings(sorted(e.vocabulary)) for e in own])}, trim(s.value))"
    passes = f"s.start >= 0 AND s.start < s.end AND coalesce(s.score >= {threshold}, false) AND NOT {written}"
    bare = "named_struct('start', s.start, 'end', s.end, 'entity_type', s.entity_type, 'recognizer', s.recognizer, 'score', s.score, 'context_term', s.context_term, 'action', s.action, 'value', s.value)"
    context = f"named_struct('folded', {blocks('__folded')}, 'folded_length', char_length(__folded), 'length', char_length(__text), 'same', __folded = __text, 'text', CASE WHEN __folded = __text THEN NULL ELSE {blocks('__text')} END)"
    body = let(context, "x", let("__judged", "ms", f"transform(filter(transform({kept}, s -> {made}), s -> {passes}), s -> {bare})"))
    return f"CASE WHEN size(__judged) > 0 THEN {body} ELSE CAST(array() AS array<{FOUND}>) END"


FOUND = "struct<start:int,end:int,entity_type:string,recognizer:string,score:double,context_term:string,action:string,value:string>"


def deconflicted(spans: str) -> str:
    """Spans without those contained in a kept one: longest first, then score, specificity, name.

    Containment is transitive, so it is enough to order spans by start and
    descending end and to compare each with the farthest end before it. An ALLOW
    span never swallows one that is to be masked or blocked.
    """
    specific = " OR ".join(f"startswith(s.entity_type, {quoted(p)})" for p in SPECIFIC)
    key = f"named_struct('a', s.start, 'b', -s.end, 'c', -s.score, 'd', -CAST(({specific}) AS int), 'e', s.entity_type, 'span', s)"
    ordered = f"transform(array_sort(transform({spans}, s -> {key})), k -> k.span)"
    every, strong = running("transform(os, s -> s.end)", True), running("transform(os, s -> CASE WHEN s.action = 'ALLOW' THEN -1 ELSE s.end END)", True)
    reached = lambda f: f"coalesce(get(f.{f}, i - 1), -1)"
    gone = f"s.end <= CASE WHEN s.action = 'ALLOW' THEN {reached('every')} ELSE {reached('strong')} END"
    whole = let(ordered, "os", let(f"named_struct('every', {every}, 'strong', {strong})", "f", f"filter(os, (s, i) -> NOT {gone})"))
    return f"CASE WHEN size({spans}) > 1 THEN {whole} ELSE {spans} END"


def joined(spans: str) -> str:
    """Partly overlapping spans (start, end, replacement) as one, under the replacement of the first."""
    # A span begins a new piece if all before it have ended.
    begins = "filter(transform(os, (s, i) -> CASE WHEN i = 0 OR get(es, i - 1) <= s.start THEN i END), i -> i IS NOT NULL)"
    piece = "named_struct('start', get(os, i).start, 'end', get(es, coalesce(get(bs, k + 1), size(os)) - 1), 'replacement', get(os, i).replacement)"
    return let(f"array_sort({spans})", "os", let(running("transform(os, s -> s.end)", True), "es", let(begins, "bs", f"transform(bs, (i, k) -> {piece})")))
