"""Column functions over move text and move lists. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
RESULTS = ("1-0", "0-1", "1/2-1/2", "*")
#: One move in standard algebraic notation, by syntax only.
SAN = r"^(?:[KQRBN][a-h]?[1-8]?x?[a-h][1-8]|(?:[a-h]x)?[a-h][1-8](?:=?[QRBN])?|[O0]-[O0](?:-[O0])?)[+#]?$"
EVAL = r"\[%eval (#?-?[0-9]+(?:\.[0-9]+)?)\]"
DOTTED = {"dotted": r"[0-9+]*\.", "dotted_space": r"[0-9+]*\. "}
MATING = r"[KQRBN]?[a-h]?[1-8]?x?[a-h][1-8](?:=[QRBN])?#"
#: What a mate in n counts as, for White; from the last on, all count alike.
MATES = {0: 600.0, 1: 500.0, 2: 400.0, 3: 300.0, 4: 200.0}


def strip_comments(c: Column) -> Column:
    return F.regexp_replace(c, r"\{[^}]*\}", "")


def strip_variations(c: Column) -> Column:
    return F.regexp_replace(c, r"\([^)]*\)", "")


def strip_nags(c: Column) -> Column:
    return F.regexp_replace(c, r"\$\d+", "")


def strip_clocks(c: Column) -> Column:
    return F.regexp_replace(c, r" ?\[%clk \d+:\d+:\d+\] ?", "")


def _tokens(c: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(c, r"\s+", " ")), " ")


def strip_move_numbers(c: Column, mode: str = "token") -> Column:
    """`inline`: from the text, wherever digits and one to three dots stand. `dotted`: from the
    text, any dot with the digits and plus signs before it; `dotted_space`: only with a space after
    it, which goes too. `token`: from a list, tokens that are digits and dots alone."""
    if mode == "inline":
        return F.regexp_replace(c, r"\d+\.{1,3}\s*", "")
    if mode in DOTTED:
        return F.regexp_replace(c, DOTTED[mode], "")
    if mode == "token":
        return F.filter(c, lambda t: ~t.rlike(r"^\d+\.+$"))
    raise ValueError(mode)


def san_moves(movetext: Column, numbers: str = "token", drop_results: bool = True) -> Column:
    """The moves of a game, without comments, variations, glyphs, numbers and result. Null text
    gives an empty list. drop_results=False keeps the result as the last token of a line."""
    text = strip_nags(strip_variations(strip_comments(F.coalesce(movetext, F.lit("")))))
    tokens = strip_move_numbers(_tokens(text)) if numbers == "token" else _tokens(strip_move_numbers(text, numbers))
    tokens = F.transform(tokens, lambda t: F.rtrim(t, F.lit("?!")))
    return F.filter(tokens, lambda t: (t != "") & (~t.isin(*RESULTS) if drop_results else F.lit(True)))


def side_and_number(ply: int) -> tuple[str, int]:
    """Ply 1 is ("W", 1), ply 2 ("B", 1)."""
    return ("W" if ply % 2 else "B"), (ply + 1) // 2


def move_columns(n: int) -> list[str]:
    return ["%s%d" % side_and_number(p) for p in range(1, 2 * n + 1)]


def wide_moves(moves: Column, n: int = 20) -> list[Column]:
    """2n columns W1, B1 ... Wn, Bn; null after the end."""
    return [F.get(moves, F.lit(k)).alias(name) for k, name in enumerate(move_columns(n))]


def truncate_moves(moves: Column, move: int) -> Column:
    """What comes before White's move number `move`."""
    return F.slice(moves, 1, 2 * (move - 1))


def line_key(moves: Column, length: Column) -> Column:
    return F.array_join(F.slice(moves, F.lit(1), length), " ")


def valid_length(moves: Column) -> Column:
    """The number of moves before the first one that can't be read."""
    bad = F.array_position(F.transform(moves, lambda m: m.rlike(SAN)), False)
    return F.coalesce(F.nullif(bad, F.lit(0)) - 1, F.size(moves)).cast("int")  # each move is looked at once


def running_prefix(moves: Column) -> Column:
    ends = F.when(F.size(moves) > 0, F.sequence(F.lit(1), F.size(moves))).otherwise(F.array().cast("array<int>"))
    return F.transform(ends, lambda i: F.array_join(F.slice(moves, F.lit(1), i), " "))


def eval_texts(movetext: Column) -> Column:
    """The text of each evaluation in the move text, in order; an empty comment counts as NA."""
    filled = F.regexp_replace(F.coalesce(movetext, F.lit("")), r"\{\s*\}", "{ [%eval NA] }")
    found = F.regexp_extract_all(filled, F.lit(r"\[%eval (#?-?[0-9]+(?:\.[0-9]+)?|NA)\]"), F.lit(1))
    return F.transform(found, lambda x: F.nullif(x, F.lit("NA")))


def brace_evals(movetext: Column) -> Column:
    """The texts between braces, one for each, where comments are `{eval x}` or empty. An empty one
    is null, but after a move that mates #0 (White's, which has a number before it) or #-0."""
    text = F.replace(F.coalesce(movetext, F.lit("")), F.lit("eval "), F.lit(""))
    text = F.replace(text, F.lit("{}"), F.lit("{NA}"))
    text = F.regexp_replace(text, rf"(\d+\. {MATING}) \{{NA\}}", "$1 {#0}")
    text = F.regexp_replace(text, rf"({MATING}) \{{NA\}}", "$1 {#-0}")
    return F.transform(F.regexp_extract_all(text, F.lit(r"\{([^}]+)\}"), F.lit(1)), lambda x: F.nullif(x, F.lit("NA")))


def game_evals(movetext: Column, moves: Column) -> Column:
    """One evaluation text for each move, as far as the text goes. A last move that mates carries
    none: #0 if White mates, #-0 if Black does."""
    n = F.size(moves)
    mate = F.when(n % 2 == 1, "#0").otherwise("#-0")
    evals = eval_texts(movetext)
    mated = (n > 0) & F.element_at(F.concat(F.array(F.lit("")), moves), -1).endswith("#") & (F.size(evals) == n - 1)
    return F.when(mated, F.concat(evals, F.array(mate))).otherwise(evals)


def eval_value(c: Column) -> Column:
    """Pawns from White's side; mates become steps. `#0` and `#-0` are told apart as text."""
    n = F.regexp_extract(c, r"^#(-?)([0-9]+)$", 2).try_cast("int")
    sign = F.when(F.substring(c, 2, 1) == "-", -1.0).otherwise(1.0)
    last = max(MATES)
    size = F.lit(MATES[last])
    for k in range(last - 1, -1, -1):
        size = F.when(n == k, MATES[k]).otherwise(size)
    return F.when(F.substring(c, 1, 1) == "#", F.when(n.isNotNull(), sign * size)).otherwise(c.try_cast("double"))


def eval_columns(n: int) -> list[str]:
    return [f"{c.lower()}_eval" for c in move_columns(n)]


def wide_evals(values: Column, n: int = 20) -> list[Column]:
    return [F.get(values, F.lit(k)).alias(name) for k, name in enumerate(eval_columns(n))]


def state_text(moves: Column, ply: Column, key: str = "moveset") -> Column:
    """The state before ply `ply` (from 1). `path`: the moves so far. `moveset`: White's moves
    sorted, Black's sorted, and the side to move, so that move orders that meet are one state."""
    before = F.slice(moves, F.lit(1), ply - 1)
    if key == "path":
        return F.array_join(before, " ")
    if key != "moveset":
        raise ValueError(key)
    side = lambda odd: F.array_join(F.sort_array(F.filter(before, lambda _, i: i % 2 == odd)), " ")
    return F.concat(side(0), F.lit("|"), side(1), F.lit("|"), F.when(ply % 2 == 1, "w").otherwise("b"))


def state_texts(moves: Column, n: Column, key: str = "moveset") -> Column:
    """state_text before the plies 1 to n + 1, as one array. Each side's text is written once for each of
    its moves, and a state puts two of them together."""
    steps = F.when(n > 0, F.slice(moves, F.lit(1), n)).otherwise(F.array().cast("array<string>"))
    if key == "path":
        path = lambda a, x: F.struct(F.concat(a["done"], F.array(F.concat(F.element_at(a["done"], -1), F.when(F.size(a["done"]) == 1, "").otherwise(" "), x))).alias("done"))
        return F.aggregate(steps, F.struct(F.array(F.lit("")).alias("done")), path, lambda a: a["done"])
    if key != "moveset":
        raise ValueError(key)
    side = lambda odd: F.filter(steps, lambda _, i: i % 2 == odd)
    texts = lambda own: F.transform(F.sequence(F.lit(0), F.size(own)), lambda k: F.array_join(F.sort_array(F.slice(own, F.lit(1), k)), " "))

    def written(white: Column, black: Column) -> Column:
        def state(k: Column) -> Column:
            return F.concat(F.get(white, F.shiftright(k + 1, 1)), F.lit("|"), F.get(black, F.shiftright(k, 1)), F.when(k % 2 == 0, "|w").otherwise("|b"))

        return F.transform(F.sequence(F.lit(0), F.size(white) + F.size(black) - 2), state)

    return _let(_let(side(0), texts), lambda white: _let(_let(side(1), texts), lambda black: written(white, black)))


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def key64(state: Column) -> Column:
    """A positive 60-bit key of a state's text."""
    return F.conv(F.substring(F.md5(state), 1, 15), 16, 10).cast("bigint")
