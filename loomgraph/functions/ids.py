"""Canonical ids and terms as column expressions, with the same rules as DuckDB SQL text for oracles.

*Plain form* of an id: upper case, a bare concept id (``C30000000``) or ``NAMESPACE:LOCAL``. Two spellings are the
same id when their plain forms are equal; letter case, white space, signs, the order of the parts and a CUI mark
do not count. An id without a letter or digit is no id (null).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space of any kind (Unicode White_Space and the ASCII separators 1C-1F).
WHITE = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))

#: Spellings that already are plain forms; they skip the slow path.
PLAIN = r"^(?!CUI:)(?:[A-Z]{2,}:)?[A-Z]*[0-9][A-Z0-9]*\z|^[A-Z]{4,}:[A-Z]-[A-Z]{2,3}-[0-9]+\z"


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once per row."""
    return F.transform(F.array(value), body)[0]


def plain_id(column: str | Column) -> Column:
    c = F.col(column) if isinstance(column, str) else column

    def ordered(tokens: Column) -> Column:
        return let(
            F.array_sort(F.transform(F.filter(tokens, lambda t: t.rlike(r"^\p{L}+\z")), lambda t: F.struct(F.length(t).alias("n"), t.alias("t")))),
            lambda words: F.when(F.size(words) == 0, F.array_join(F.array_sort(tokens), "-")).otherwise(
                F.concat(
                    words[F.size(words) - 1]["t"],
                    F.lit(":"),
                    F.array_join(
                        F.concat(
                            F.transform(F.slice(words, 1, F.size(words) - 1), lambda w: w["t"]),
                            F.array_sort(F.filter(tokens, lambda t: ~t.rlike(r"^\p{L}+\z"))),
                        ),
                        "-",
                    ),
                )
            ),
        )

    def marked(tokens: Column) -> Column:
        return let(F.filter(tokens, lambda t: t != "CUI"), lambda kept: F.when(F.size(kept) > 0, kept).otherwise(F.slice(tokens, 1, 1)))

    slow = let(
        F.filter(F.split(F.upper(c), r"[^\p{L}\p{N}]+"), lambda t: t != ""),
        lambda raw: let(marked(raw), lambda t: F.when(F.size(t) == 1, t[0]).when(F.size(t) > 1, ordered(t))),
    )
    return F.when(c.rlike(PLAIN), c).otherwise(slow)


def plain_id_sql(c: str) -> str:
    """``plain_id`` in DuckDB SQL."""
    alpha = r"regexp_full_match(x, '\p{L}+')"
    words = f"list_sort(list_transform(list_filter(t, lambda x: {alpha}), lambda x: {{'n': length(x), 't': x}}))"
    rest = f"list_concat(list_transform(w[1:len(w)-1], lambda x: x.t), list_sort(list_filter(t, lambda x: NOT {alpha})))"
    ordered = f"CASE WHEN len(w) = 0 THEN array_to_string(list_sort(t), '-') ELSE w[len(w)].t || ':' || array_to_string({rest}, '-') END"
    whole = f"CASE WHEN len(t) = 0 THEN NULL WHEN len(t) = 1 THEN t[1] ELSE list_transform([{words}], lambda w: {ordered})[1] END"
    kept = "CASE WHEN len(list_filter(r, lambda x: x <> 'CUI')) > 0 THEN list_filter(r, lambda x: x <> 'CUI') ELSE r[1:1] END"
    raw = rf"list_filter(regexp_split_to_array(upper({c}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
    return f"list_transform([{raw}], lambda r: list_transform([{kept}], lambda t: {whole})[1])[1]"


def term(column: str | Column, case: str) -> Column:
    """Term without surrounding white space, in ``upper`` or ``lower`` case; null and blank are no term."""
    c = F.col(column) if isinstance(column, str) else column
    bare = F.btrim(c, F.lit(WHITE))
    return F.nullif(F.upper(bare) if case == "upper" else F.lower(bare), F.lit(""))


def term_sql(c: str, case: str) -> str:
    chars = " || ".join(f"chr({ord(x)})" for x in WHITE)
    return f"nullif({case}(trim({c}, {chars})), '')"
