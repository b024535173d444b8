"""Raw bibliographic records: their schema, and groups of exported columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citegrain.functions import ids, text, values

_ENTITY = "struct<id:string,type:string,display_name:string>"
_NAMED = "struct<id:string,display_name:string>"
_TOPIC = f"struct<id:string,display_name:string,subfield:{_NAMED},field:{_NAMED},domain:{_NAMED}>"
SCHEMA = (
    "id string, title string, doi string, publication_date string, publication_year int, type string, language string, cited_by_count int, ids struct<mag:string>, "
    "referenced_works array<string>, abstract_inverted_index map<string,array<int>>, "
    f"authorships array<struct<author:{_NAMED},author_position:string,institutions:array<{_ENTITY}>>>, primary_location struct<source:{_ENTITY}>, locations array<struct<source:{_ENTITY}>>, "
    f"grants array<struct<funder:string,funder_display_name:string>>, primary_topic {_TOPIC}, topics array<{_TOPIC}>, corresponding_author_ids array<string>, corresponding_institution_ids array<string>"
)


def _flat(items: str, get) -> Column:  # noqa: ANN001
    return values.blanks_for_nulls(F.transform(items, get))


def core() -> dict[str, Column]:
    located = F.filter("locations", lambda x: x["source"]["id"].isNotNull())
    every = F.flatten(F.transform("authorships", lambda a: F.coalesce(a["institutions"], F.array().cast(f"array<{_ENTITY}>"))))
    positions = F.transform("authorships", lambda a: values.code(a["author_position"], values.AUTHOR_POSITIONS))
    authors = F.transform("authorships", lambda a: F.coalesce(ids.bare_id(a["author"]["id"]), F.lit("")))
    placed = F.arrays_zip(authors.alias("a"), positions.alias("p"))
    return {
        "id": ids.bare_id(F.col("id")),
        "title": F.col("title"),
        "doi": F.col("doi"),
        "publication_date": F.col("publication_date"),
        "publication_year": values.year_of(F.col("publication_year").cast("string"), F.col("publication_date")),
        "type": F.col("type"),
        "language": F.col("language"),
        "cited_by_count": F.col("cited_by_count"),
        "abstract": text.abstract(F.col("abstract_inverted_index")),
        "refs": ids.bare_ids(F.col("referenced_works")),
        "author_ids": authors,
        "author_positions": positions,
        "first_author_id": F.filter(placed, lambda x: x["p"] == "f")[0]["a"],
        "last_author_id": F.filter(placed, lambda x: x["p"] == "l")[0]["a"],
        "institution_ids": F.transform(every, lambda i: F.coalesce(ids.bare_id(i["id"]), F.lit(""))),
        "institution_types": F.transform(every, lambda i: values.code(i["type"], values.INSTITUTION_TYPES)),
        "primary_source_id": ids.bare_id(F.col("primary_location.source.id")),
        "primary_source_name": F.col("primary_location.source.display_name"),
        "primary_source_type": values.code(F.col("primary_location.source.type"), values.SOURCE_TYPES, None),
        "location_source_ids": F.transform(located, lambda x: ids.bare_id(x["source"]["id"])),
        "corresponding_author_ids": ids.bare_ids(F.col("corresponding_author_ids")),
        "corresponding_institution_ids": ids.bare_ids(F.col("corresponding_institution_ids")),
    }


def grants() -> dict[str, Column]:
    return {"funder_ids": _flat("grants", lambda g: ids.bare_id(g["funder"])), "funder_names": _flat("grants", lambda g: g["funder_display_name"]), "grants_info": F.to_json("grants")}


def topics() -> dict[str, Column]:
    levels = ("subfield", "field", "domain")
    own = {f"primary_{k}": ids.bare_id(F.col(f"primary_topic.{k}.id")) for k in levels}
    return {"primary_topic_id": ids.bare_id(F.col("primary_topic.id")), **own, "topic_ids": _flat("topics", lambda t: ids.bare_id(t["id"])), "field_number": ids.field_number(F.col("primary_topic.field.id"))}


def display() -> dict[str, Column]:
    return {"author_names": _flat("authorships", lambda a: a["author"]["display_name"]), "primary_topic_name": F.col("primary_topic.display_name"), "primary_field_name": F.col("primary_topic.field.display_name")}


GROUPS = {"core": core, "grants": grants, "topics": topics, "display_fields": display}


def exported(works: DataFrame, *groups: str) -> DataFrame:
    """The columns of some groups; only what they need is read."""
    columns = {}
    for g in groups or GROUPS:
        columns |= GROUPS[g]()
    return works.select(*[c.alias(n) for n, c in columns.items()])
