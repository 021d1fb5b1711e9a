"""Explicit schemas of every dataset; readers never infer."""

from __future__ import annotations

from pyspark.sql.types import StructType

_DDL = {
    "raw_paper": "id string, title string, year string, abstract string, citationCount long, referenceCount long, doi string, authors array<string>",
    "openalex_paper": "id string, title string, doi string, abstract string, year string, cited_by_count long",
    "api_paper": "paperId string, title string, abstract string, year int, citationCount long, referenceCount long, externalIds struct<DOI:string>, authors array<struct<name:string>>",
    "clean_paper": "id string, title string, year int, abstract string, cited_by_count long",
    "quad": "subject string, relation string, object string, year string, paper_id string",
    "llm_quads": "array<struct<subject:string,relation:string,object:string,year:string>>",
    "node": "id string, label string",
    "edge": "source string, target string, key string, relation string, year int, timestamp int, paper_id string",
    "graph": "nodes array<struct<id:string,label:string>>, edges array<struct<source:string,target:string,key:string,relation:string,year:int,timestamp:int,paper_id:string>>",
    "pair": "node_a string, node_b string, cutoff_year int, label int",
    "embedding": "cutoff_year int, node string, vec array<float>",
    "features": "node_a string, node_b string, cutoff_year int, label int, x array<double>, cos_sim double",
    "gap": "type string, rank int, node_a string, node_b string, label_a string, label_b string, probability double, confidence string, cosine_similarity double, degree_a long, degree_b long, common_neighbors long",
    "merge_candidate": "longer string, shorter string, similarity double, risky boolean",
}


def ddl(name: str) -> str:
    return _DDL[name]


def schema(name: str) -> StructType:
    return StructType.fromDDL(_DDL[name])
