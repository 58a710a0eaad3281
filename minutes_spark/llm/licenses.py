"""License scans by sentence rules.

The ends of sentences are marked in a text, and the rest is normalised to lower-case words joined
by single spaces. A known license sentence is looked for from a mark on, up to a mark; marks
inside it (a colon, a number such as "v. 2.0", a line end) do not cut it, and of several known
sentences that begin at a mark the longest counts. The identifiers, in the order of the text, are
matched against ordered license rules: a rule is a sequence of identifiers with at most
``GAP`` other known sentences between two of them. Rules are tried in order and use up what
they match, so a full text comes before the short notice that its first sentence alone would be.

All work is done by built-in column functions; nothing is shuffled.

Cases: null and empty texts have no licenses; a sentence that occurs twice can match twice;
matches of one rule are reported once per match, in the order of the rules; repeated rows get
equal results; other columns of the input stay unless they have a result's name.
"""

import re

from pyspark.sql import functions as F

#: Known sentences that may stand between two sentences of a rule.
GAP = 2
# License sentences in their normal form, by identifier.
SENTENCES = {
    "mit_name": "the mit license",
    "mit_released": "released under the mit license",
    "mit_licensed": "licensed under the mit license",
    "mit_grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and "
    "associated documentation files the software to deal in the software without restriction including without "
    "limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software "
    "and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit_notice": "the above copyright notice and this permission notice shall be included in all copies or "
    "substantial portions of the software",
    "as_is": "the software is provided as is without warranty of any kind express or implied including but not limited "
    "to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "isc_grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is "
    "hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "bsd_use": "redistribution and use in source and binary forms with or without modification are permitted provided "
    "that the following conditions are met",
    "bsd_source": "redistributions of source code must retain the above copyright notice this list of conditions and "
    "the following disclaimer",
    "bsd_binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions "
    "and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd_names": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
    "promote products derived from this software without specific prior written permission",
    "apache_licensed": "licensed under the apache license version 2 0",
    "apache_licensed_the": "licensed under the apache license version 2 0 the license",
    "apache_comply": "you may not use this file except in compliance with the license",
    "apache_copy": "you may obtain a copy of the license at",
    "gpl3_work": "this work is licensed under the gnu general public license version 3",
    "gpl_name": "gnu general public license",
    "gpl_free": "this program is free software you can redistribute it and or modify it under the terms of the gnu "
    "general public license as published by the free software foundation either version 3 of the license or at your "
    "option any later version",
    "gpl2_free": "this program is free software you can redistribute it and or modify it under the terms of the gnu "
    "general public license as published by the free software foundation either version 2 of the license or at your "
    "option any later version",
    "gpl_hope": "this program is distributed in the hope that it will be useful but without any warranty without even "
    "the implied warranty of merchantability or fitness for a particular purpose",
    "mpl_subject": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "cc_by_nc": "licensed under cc by nc 4 0",
    "cc_by": "licensed under cc by 4 0",
    "cc_by_sa": "licensed under cc by sa 4 0",
    "cc0": "to the extent possible under law the author has waived all copyright and related or neighboring rights to "
    "this work",
    "unlicense": "this is free and unencumbered software released into the public domain",
}
# Fixed values: (license, identifiers in their order); earlier rules come first.
RULES = (
    ("BSD-3-Clause", ("bsd_use", "bsd_source", "bsd_binary", "bsd_names")),
    ("BSD-2-Clause", ("bsd_use", "bsd_source", "bsd_binary")),
    ("MIT", ("mit_name", "mit_grant", "mit_notice", "as_is")),
    ("MIT", ("mit_grant", "mit_notice", "as_is")),
    ("MIT", ("mit_grant",)),
    ("ISC", ("isc_grant", "as_is")),
    ("ISC", ("isc_grant",)),
    ("Apache-2.0", ("apache_licensed_the", "apache_comply", "apache_copy")),
    ("Apache-2.0", ("apache_licensed_the",)),
    ("Apache-2.0", ("apache_licensed",)),
    ("GPL-3.0-or-later", ("gpl_free", "gpl_hope")),
    ("GPL-3.0-or-later", ("gpl_free",)),
    ("GPL-2.0-or-later", ("gpl2_free", "gpl_hope")),
    ("GPL-2.0-or-later", ("gpl2_free",)),
    ("GPL-3.0", ("gpl3_work",)),
    ("MPL-2.0", ("mpl_subject",)),
    ("CC-BY-NC-4.0", ("cc_by_nc",)),
    ("CC-BY-SA-4.0", ("cc_by_sa",)),
    ("CC-BY-4.0", ("cc_by",)),
    ("CC0-1.0", ("cc0",)),
    ("Unlicense", ("unlicense",)),
    ("MIT", ("mit_released",)),
    ("MIT", ("mit_licensed",)),
)
# a sentence ends at a mark that white space or the end follows, at an empty line, or at a line
# end before a capitalised word
ENDS = "[.!?;:]+(?=\\s|$)|\\n(?=\\s*\\n)|\\n(?=\\s*\\p{Lu}\\p{Ll})"
#: Stands for the end of a sentence in a normalised text.
MARK = "\x01"
OTHER_LETTERS = "[^\\p{L}\\p{N}\x01]+"


def _marked(rule):
    """Pattern of a rule over the text of identifiers, each written as <id>."""
    gap = f"(?:<[a-z0-9_]+>){{0,{GAP}}}?"
    return gap.join(f"<{name}>" for name in rule)


def _sought(known):
    """Pattern of a known sentence between two marks, the sentence being its group."""
    longest_first = sorted(known.values(), key=lambda s: (-len(s), s))
    inside = [f"[ {MARK}]+".join(re.sub(r"(\W)", r"\\\1", word) for word in s.split(" ")) for s in longest_first]
    return f"{MARK} ?({'|'.join(inside)})(?= ?{MARK})"


def recognise(docs, text="text", known=None, rules=RULES):
    """``docs`` with sentence_ids, in the order of the text, and licenses, in the order of the rules."""
    known = SENTENCES if known is None else known
    ids = F.create_map(*(F.lit(x) for name, sentence in known.items() for x in (sentence, f"<{name}>")))
    body = F.replace(F.coalesce(F.col(text), F.lit("")), F.lit(MARK), F.lit(" "))
    marked = F.concat(F.lit(MARK), F.regexp_replace(body, ENDS, MARK), F.lit(MARK))
    normal = F.regexp_replace(F.lower(marked), OTHER_LETTERS, " ")
    parts = F.regexp_extract_all(normal, F.lit(_sought(known)), F.lit(1))
    name = lambda s: F.element_at(ids, F.regexp_replace(s, f"[ {MARK}]+", " "))
    found = docs.withColumn("_ids", F.transform(parts, name))
    out = found.withColumns({"_left": F.array_join("_ids", ""), "_licenses": F.array().cast("array<string>")})
    for name, rule in rules:
        pattern = F.lit(_marked(rule))
        n = F.size(F.regexp_extract_all("_left", pattern, F.lit(0)))
        hit = F.col("_left").contains(f"<{rule[0]}>")
        out = out.withColumns(
            {
                "_licenses": F.when(hit, F.concat("_licenses", F.array_repeat(F.lit(name), n))).otherwise(F.col("_licenses")),
                "_left": F.when(hit, F.regexp_replace("_left", pattern, F.lit("<>"))).otherwise(F.col("_left")),
            }
        )
    return out.withColumns(
        {
            "sentence_ids": F.transform("_ids", lambda s: F.substring(s, F.lit(2), F.length(s) - 2)),
            "licenses": F.col("_licenses"),
        }
    ).drop("_ids", "_left", "_licenses")
