"""Types, dimension rows and fixed values of the fragment model."""

from __future__ import annotations

from pyspark.sql import types as T

LEVEL = T.StructType([T.StructField("group_type", T.StringType()), T.StructField("group_number", T.IntegerType()), T.StructField("title", T.StringType()), T.StructField("id", T.StringType())])

#: A fragment as the store holds it; (cst_file, frag_idx_code) is its key.
FRAGMENT = T.StructType(
    [
        T.StructField("cst_file", T.StringType(), False),
        T.StructField("frag_idx_code", T.StringType(), False),
        T.StructField("frag_type", T.StringType(), False),
        T.StructField("frag_review", T.StringType()),
        T.StructField("nikaya", T.StringType(), False),
        *(T.StructField(c, T.StringType()) for c in ("cst_code", "sc_code")),
        T.StructField("content_xml", T.StringType(), False),
        *(T.StructField(c, T.StringType()) for c in ("cst_vagga", "cst_sutta", "cst_paranum", "sc_sutta")),
        *(T.StructField(c, T.IntegerType(), False) for c in ("start_line", "start_char", "end_line", "end_char")),
        T.StructField("group_levels", T.ArrayType(LEVEL)),
    ]
)
COLUMNS = FRAGMENT.names
CODES = ("cst_code", "sc_code", "cst_vagga", "cst_sutta", "cst_paranum", "sc_sutta")

SOURCE = "cst_file string, content string"
TITLES = "uid string, name string"
MAPPING = "cst_file string, cst_code string, cst_vagga string, cst_sutta string, cst_paranum string, code string, sutta string"

#: A reviewer's correction of a generated fragment. collapse: its text was moved away.
OVERRIDE = T.StructType(
    [
        T.StructField("cst_file", T.StringType()),
        T.StructField("frag_idx_code", T.StringType()),
        T.StructField("collapse", T.BooleanType()),
        *(T.StructField(c, T.IntegerType()) for c in ("start_line", "start_char", "end_line", "end_char")),
        *(T.StructField(c, T.StringType()) for c in (*CODES, "frag_review", "frag_type")),
    ]
)

#: Columns of the fragment TSV, in order.
TSV_COLUMNS = (
    "cst_file frag_idx_code frag_type frag_review nikaya cst_code sc_code cst_vagga cst_sutta cst_paranum sc_sutta "
    "start_line start_char end_line end_char group_levels"
).split()

#: Level types of each collection, from the top. Fixed values.
LEVELS = {
    "digha": ("Nikaya", "Book", "Sutta"),
    "majjhima": ("Nikaya", "Book", "Vagga", "Sutta"),
    "samyutta": ("Nikaya", "Book", "Samyutta", "Vagga", "Sutta"),
    "anguttara": ("Nikaya", "Book", "Pannasaka", "Vagga", "Sutta"),
    "khuddaka": ("Nikaya", "Book", "Sutta"),
}
#: Spellings that name a collection, looked for in this order in lower-cased text. Fixed values.
SPELLINGS = {
    "digha": ("dīgha", "digha"),
    "majjhima": ("majjhima",),
    "samyutta": ("saṃyutta", "samyutta"),
    "anguttara": ("aṅguttara", "anguttara"),
    "khuddaka": ("khuddaka",),
}
DISPLAY = {"digha": "Dīgha Nikāya", "majjhima": "Majjhima Nikāya", "samyutta": "Saṃyutta Nikāya", "anguttara": "Aṅguttara Nikāya", "khuddaka": "Khuddaka Nikāya"}
#: Endings of commentary subheads that open a section. The last is a misspelling of the sources. Fixed values.
SECTION_ENDINGS = ("suttavaṇṇanā", "suttādivaṇṇanā", "suttadvayavaṇṇanā", "suttavaṇṇṇanā")
NUMBERED_ENDINGS = ("vaṇṇanā", "vaṇṇṇanā")
