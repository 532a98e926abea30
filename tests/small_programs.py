"""Small programs as text, and what is known of them."""

from __future__ import annotations

#: A program with loops, branches and a call.
ALPHA = """
procedure alpha {
  n = 3;
  while (n > 0) {
    t = n * 2 + k;
    if (t == k) then { n = n - 1; } else { read k; }
    call beta;
  }
  print t;
}
procedure beta { k = t; t = k + n; }
"""

#: Programs that break a rule each, and what is said about them.
BROKEN = {
    "braces": ("procedure a { x = 1;", ["braces do not match"]),
    "character": ("procedure a { x = 1 ^ 2; }", ["unknown character", "no expression"]),
    "double": ("procedure a { x = 1; } procedure a { x = 2; }", ["procedure declared twice"]),
    "missing": ("procedure a { call b; }", ["undeclared procedure called"]),
    "recursive": ("procedure a { call b; } procedure b { call a; }", ["recursive call"]),
    "empty": (" ", ["no procedure"]),
    "fine": ("procedure a { while = 1; if = while; }", []),
    "semicolon": ("procedure a { x = 1 }", ["no statement"]),
    "nothing": ("procedure a { x = ; }", ["no statement"]),
    "operand": ("procedure a { x = 1 + ; }", ["no expression"]),
    "else": ("procedure a { if (x > 1) then { x = 1; } y = 2; }", ["then and else do not match"]),
    "then": ("procedure a { if (x > 1) { x = 1; } else { x = 2; } }", ["no statement", "then and else do not match"]),
    "bare": ("procedure a { while (x) { x = 1; } }", ["no condition"]),
    "test": ("procedure a { while () { x = 1; } }", ["no statement"]),
    "print": ("procedure a { print x + 1; }", ["no statement"]),
    "read": ("procedure a { read 5; }", ["no statement"]),
    "name": ("procedure { x = 1; }", ["no statement"]),
    "zero": ("procedure a { x = 01; }", ["no expression"]),
    "inner": ("procedure a { procedure b { x = 1; } }", ["no statement"]),
    "linked": ("procedure a { while ((x > 1) && (y > 2)) { if (!(x == y)) then { x = 1; } else { else = 2; } } }", []),
    "links": ("procedure a { while ((x > 1) && (y > 2) && (z > 3)) { x = 1; } }", ["no condition"]),
}

#: Rows of the relations across calls of ALPHA, worked out by hand from their definitions.
_LITERAL = {
    "next_bip": [(1, 2), (2, 3), (2, 8), (3, 4), (4, 5), (4, 6), (5, 7), (6, 7), (7, 9), (9, 10), (10, 2)],
    "next_bip_t": [(1, r) for r in range(2, 11)] + [(a, r) for a in (2, 3, 4, 5, 6, 7, 9, 10) for r in range(2, 11)],
    "affects_bip": [(1, 3), (1, 5), (1, 10), (3, 9), (5, 3), (5, 5), (5, 10), (9, 3), (9, 10)],
    "affects_bip_t": [(1, 3), (1, 5), (1, 10), (3, 9), (5, 3), (5, 5), (5, 10), (9, 3), (9, 10), (1, 9), (3, 3), (3, 10), (5, 9), (9, 9)],
}
