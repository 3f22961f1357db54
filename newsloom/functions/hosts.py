"""Host names in one spelling: labels beyond ASCII as punycode (RFC 3492), as expressions; only hosts that need it are worked on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The parameters of punycode, and its digits.
BASE, T_MIN, T_MAX, SKEW, DAMP, BIAS, START = 36, 1, 26, 38, 700, 72, 128
DIGITS = "abcdefghijklmnopqrstuvwxyz0123456789"
#: Full-width forms of ASCII (but the quote and the back slash, which no host has), and the dots that separate labels besides the plain one.
NARROW = "".join(chr(c) for c in range(0x21, 0x7F) if chr(c) not in "'\\")
WIDE = "".join(chr(ord(c) + 0xFEE0) for c in NARROW)
DOTS = "\u3002\uff0e\uff61"
#: Digits of a number at most, and halvings that bring any difference below the threshold.
MOST_DIGITS, MOST_HALVINGS = 13, 8


def _digit(d: str) -> str:
    return f"substring('{DIGITS}', CAST({d} + 1 AS INT), 1)"


def _number(delta: str, bias: str) -> str:
    """A number as digits of a base that depends on the place."""
    t = f"greatest({T_MIN}, least({T_MAX}, k * {BASE} - {bias}))"
    more = f"named_struct('q', (w.q - {t}) div ({BASE} - {t}), 'text', concat(w.text, {_digit(f'{t} + (w.q - {t}) % ({BASE} - {t})')}))"
    last = f"named_struct('q', -1L, 'text', concat(w.text, {_digit('w.q')}))"
    return f"aggregate(sequence(1, {MOST_DIGITS}), named_struct('q', {delta}, 'text', ''), (w, k) -> CASE WHEN w.q < 0 THEN w WHEN w.q >= {t} THEN {more} ELSE {last} END, w -> w.text)"


def _adapted(delta: str, points: str, first: str) -> str:
    d = f"CASE WHEN {first} THEN {delta} div {DAMP} ELSE {delta} div 2 END"
    step = f"(a, i) -> IF(a.d > {(BASE - T_MIN) * T_MAX // 2}, named_struct('d', a.d div {BASE - T_MIN}, 'k', a.k + {BASE}), a)"
    return f"aggregate(sequence(1, {MOST_HALVINGS}), named_struct('d', {d} + ({d}) div {points}, 'k', 0), {step}, a -> a.k + CAST(({BASE} * a.d) div (a.d + {SKEW}) AS INT))"


def _let(name: str, value: str, use: str) -> str:
    """What ``use`` makes of a value that's computed once."""
    return f"element_at(transform(array({value}), {name} -> {use}), 1)"


def _encoded(label: str) -> str:
    """A label with characters beyond ASCII: its plain ones, then where the others go in, by code point and place."""
    lower = lambda cp, test: f"size(filter(ps, x -> x.cp < {cp} AND {test}))"
    plain = f"filter(ps, x -> x.cp < {START})"
    jump, before = "CAST(p.cp - s.n AS BIGINT) * (s.h + 1)", lower("p.cp", "x.pos < p.pos")
    delta = f"CASE WHEN s.pos < 0 THEN {jump} + {before} WHEN p.cp = s.n THEN CAST({lower('p.cp', 'x.pos > s.pos AND x.pos < p.pos')} AS BIGINT) ELSE {lower('s.n', 'x.pos > s.pos')} + 1 + {jump} - (s.h + 1) + {before} END"
    step = _let("d", delta, f"named_struct('n', p.cp, 'pos', p.pos, 'h', s.h + 1, 'b', s.b, 'bias', {_adapted('d', '(s.h + 1)', 's.h = s.b')}, 'text', concat(s.text, {_number('d', 's.bias')}))")
    begin = f"named_struct('n', {START}, 'pos', -1, 'h', size({plain}), 'b', size({plain}), 'bias', {BIAS}, 'text', '')"
    others = f"aggregate(array_sort(filter(ps, x -> x.cp >= {START})), {begin}, (s, p) -> {step}, s -> s.text)"
    text = f"concat('xn--', array_join(transform({plain}, x -> x.c), ''), IF(exists(ps, x -> x.cp < {START}), '-', ''), {others})"
    return _let("ps", f"transform(split({label}, ''), (c, i) -> named_struct('cp', ascii(c), 'pos', i, 'c', c))", text)


BEYOND = r"[^\\x00-\\x7f]"
PLAIN = f"lower(translate(translate(h, '{WIDE}', '{NARROW}'), '{DOTS}', '...'))"
LABELS = f"transform(split({PLAIN}, '[.]'), g -> IF(g RLIKE '{BEYOND}', {_encoded('g')}, g))"
SPELLED = f"h -> IF(h RLIKE '{BEYOND}', array_join({LABELS}, '.'), h)"


def ascii_host(host: Column) -> Column:
    """A lower-case host in ASCII: full-width forms are narrow, all label dots plain, other labels punycode. Composed letters are taken as they're
    written: a decomposed spelling is another host. The expression is long, and given as text, which is parsed at once."""
    return F.element_at(F.call_function("transform", F.array(host), F.expr(SPELLED)), 1)
