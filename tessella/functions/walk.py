"""Walks over JSON text of any depth inside the JVM: one fold along its tokens, whose state is what is open.

A text's strings are told apart by splitting at its quotes, once its escaped backslashes and quotes are held by
control characters, which valid JSON never has as such. Texts that are no JSON give no error, but no defined result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stand for an escaped backslash and an escaped quote while a text is split.
BACKSLASH, QUOTE = "\x01", "\x02"
#: Tokens whose pieces are put together before they join those of the tokens before, so no long array is copied at every token.
CHUNK = 256


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is referred to."""
    return F.transform(F.array(value), use)[0]


def segments(json: Column) -> Column:
    """The text cut at its quotes: structure and contents of strings by turns, structure first."""
    held = F.replace(F.replace(json, F.lit("\\\\"), F.lit(BACKSLASH)), F.lit('\\"'), F.lit(QUOTE))
    return F.split(held, '"')


def decoded(content: Column) -> Column:
    """A string's value from its content between quotes."""
    written = F.replace(F.replace(content, F.lit(BACKSLASH), F.lit("\\\\")), F.lit(QUOTE), F.lit('\\"'))
    value = F.from_json(F.concat(F.lit('["'), written, F.lit('"]')), "array<string>")[0]
    return F.when(content.contains("\\") | content.contains(BACKSLASH) | content.contains(QUOTE), F.coalesce(value, written)).otherwise(content)


def encoded(value: Column) -> Column:
    """A string as JSON, with its quotes."""
    json = F.to_json(F.array(value))
    return F.when(value.rlike('["\\\\\x00-\x1f]'), F.substring(json, F.lit(2), F.char_length(json) - 2)).otherwise(F.concat(F.lit('"'), value, F.lit('"')))


def strings(json: Column) -> Column:
    """The text's strings in document order as structs: content, whether it is a key, and the brackets since the string before."""

    def each(p: Column) -> Column:
        odd = F.when(F.size(p) > 2, F.sequence(F.lit(1), F.size(p) - 2, F.lit(2))).otherwise(F.array().cast("array<int>"))
        before = lambda i: F.get(p, i - 1)
        brackets = lambda i: F.when(before(i).isin(":", ","), F.lit("")).otherwise(F.regexp_replace(before(i), r"[^\[\]{}]", ""))
        return F.transform(odd, lambda i: F.struct(F.get(p, i).alias("content"), F.ltrim(F.get(p, i + 1), F.lit(" \t\r\n")).startswith(":").alias("key"), brackets(i).alias("brackets")))

    return bound(segments(json), each)


def folded(tokens: Column, start: Column, nothing: Column, step: Callable[[Column, Column], Column]) -> Column:
    """All pieces that step(state, token), a struct of the next state and an array of pieces, gives along the tokens."""

    def one(done: Column, token: Column) -> Column:
        return bound(step(done["state"], token), lambda r: F.struct(r["state"].alias("state"), F.concat(done["pieces"], r["pieces"]).alias("pieces")))

    def chunk(done: Column, part: Column) -> Column:
        inner = F.aggregate(part, F.struct(done["state"].alias("state"), nothing.alias("pieces")), one)
        return bound(inner, lambda r: F.struct(r["state"].alias("state"), F.concat(done["pieces"], r["pieces"]).alias("pieces")))

    parts = bound(tokens, lambda t: F.transform(F.sequence(F.lit(0), F.floor(F.size(t) / CHUNK).cast("int")), lambda i: F.slice(t, i * CHUNK + 1, CHUNK)))
    return F.aggregate(parts, F.struct(start.alias("state"), nothing.alias("pieces")), chunk)["pieces"]


def strings_under(json: Column, wanted: Callable[[Column, Column], Column], likely: Callable[[Column], Column] = lambda content: F.lit(True)) -> Column:
    """The strings, in document order, for which wanted(nearest key in lower case, string) holds.

    A string in arrays stands under the key of the outermost of them; one under no key has the empty key.
    Where likely(content as written) is false, wanted is known to be: such strings, and keys of nothing else, are left out before the fold.
    """
    none = F.array().cast("array<string>")

    def bracket(s: Column, b: Column) -> Column:
        opened = F.struct(F.concat(s["open"], F.array(s["key"])).alias("open"), s["key"].alias("key"))
        closed = F.struct(F.slice(s["open"], F.lit(1), F.greatest(F.size(s["open"]) - 1, F.lit(0))).alias("open"), F.coalesce(F.get(s["open"], F.size(s["open"]) - 1), F.lit("")).alias("key"))
        return F.when(b.isin("[", "{"), opened).otherwise(closed)

    def step(state: Column, token: Column) -> Column:
        moved = F.when(token["brackets"] == "", state).otherwise(F.aggregate(F.split(token["brackets"], ""), state, bracket))

        def take(s: Column) -> Column:
            keyed = F.struct(F.struct(s["open"].alias("open"), F.lower(decoded(token["content"])).alias("key")).alias("state"), none.alias("pieces"))
            value = bound(decoded(token["content"]), lambda v: F.struct(s.alias("state"), F.when(wanted(s["key"], v), F.array(v)).otherwise(none).alias("pieces")))
            return F.when(token["key"], keyed).otherwise(value)

        return bound(moved, take)

    some = F.filter(strings(json), lambda t: t["key"] | (t["brackets"] != "") | likely(t["content"]))
    plain = lambda t: t["key"] & (t["brackets"] == "")  # noqa: E731  a key that follows another at once takes its place
    kept = bound(some, lambda a: F.filter(a, lambda t, i: ~(plain(t) & F.coalesce(plain(F.get(a, i + 1)), F.lit(False)))))
    return folded(kept, F.struct(none.alias("open"), F.lit("").alias("key")), none, step)


def values(json: Column, likely: Callable[[Column], Column] = lambda content: F.lit(True)) -> Column:
    """All strings of the text that are no keys, in document order, or those of them whose content as written is likely."""
    return F.transform(F.filter(strings(json), lambda s: ~s["key"] & likely(s["content"])), lambda s: decoded(s["content"]))


def tokens(json: Column) -> Column:
    """Strings (with their opening quote only), brackets, commas, colons, and other values as they are written, in order."""
    structure = lambda x: F.filter(F.split(F.regexp_replace(x, r"[ \t\r\n]+", ""), r"(?<=[\[\]{},:])|(?=[\[\]{},:])"), lambda t: t != "")
    return F.flatten(F.transform(segments(json), lambda x, i: F.when(i % 2 == 1, F.array(F.concat(F.lit('"'), x))).otherwise(structure(x))))


def rewritten(json: Column, hidden: Callable[[Column], Column], mark: str, cleaned: Callable[[Column], Column]) -> Column:
    """The text with the whole value of each key for which hidden(key) holds replaced by a mark, all other strings by cleaned(string).

    A blank follows each comma and colon, and none stands elsewhere; numbers stay as they are written.
    """
    none = F.array().cast("array<string>")

    def shown(t: Column) -> Column:
        def each(x: Column, i: Column) -> Column:
            key = F.get(t, i + 1) == ":"

            def string(v: Column) -> Column:
                secret = F.coalesce(key & hidden(v), F.lit(False))
                text = F.when(secret, F.concat(encoded(v), F.lit(": "), encoded(F.lit(mark)))).when(F.coalesce(key, F.lit(False)), encoded(v)).otherwise(bound(cleaned(v), encoded))
                return F.struct(x.alias("token"), secret.alias("secret"), text.alias("text"))

            plain = F.struct(x.alias("token"), F.lit(False).alias("secret"), F.when(x.isin(",", ":"), F.concat(x, F.lit(" "))).otherwise(x).alias("text"))
            return F.when(x.startswith('"'), bound(decoded(F.substring(x, F.lit(2), F.char_length(x))), string)).otherwise(plain)

        return F.transform(t, each)

    def step(s: Column, t: Column) -> Column:
        opens, closes = t["token"].isin("[", "{"), t["token"].isin("]", "}")
        ends = (s["since"] == s["depth"]) & (closes | (t["token"] == ","))
        hiding = (s["since"] >= 0) & ~ends
        depth = s["depth"] + F.when(opens, 1).when(closes, -1).otherwise(0)
        since = F.when(hiding, s["since"]).when(t["secret"], s["depth"]).otherwise(F.lit(-1))
        return F.struct(F.struct(depth.alias("depth"), since.alias("since")).alias("state"), F.when(hiding, none).otherwise(F.array(t["text"])).alias("pieces"))

    return F.array_join(folded(bound(tokens(json), shown), F.struct(F.lit(0).alias("depth"), F.lit(-1).alias("since")), none, step), "")
