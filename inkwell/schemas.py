"""Explicit schemas: inference would type an empty JSON array as strings."""

from __future__ import annotations

RECORD = (
    "id string, corpus string, register string, unit string, title string, entities array<struct<name:string,type:string>>, "
    "relations array<struct<type:string,head:string,tail:string>>, source_text string, subjects array<string>, provenance string"
)
SPANS = "doc_id string, text string, entities array<struct<surface:string,type:string,start:int,end:int>>"
EXTRACTED = (
    "id string, document_text string, base_entities array<struct<entity_text:string,entity_type:string>>, new_entities array<struct<entity_text:string,entity_type:string>>, "
    "relationships array<struct<relation_type:string,head_entity_text:string,tail_entity_text:string>>"
)
ATTRIBUTE = "struct<key:string,value:string,specificity:string,grounded_by:array<string>,certainty:string>"
CASE = (
    f"case_id string, focal string, entities array<struct<id:string,type:string,name:string,fictional:boolean,attributes:array<{ATTRIBUTE}>>>, "
    "events array<struct<id:string,type:string,summary:string,participants:array<struct<entity_id:string,role:string>>,place_id:string,"
    "date:struct<value:string,precision:string,certainty:string>,grounded_by:array<string>,salience:int,sensitivity:string>>, "
    "relations array<struct<head_id:string,type:string,tail_id:string,grounded_by:array<string>,certainty:string,salience:int>>, "
    "sources array<struct<id:string,kind:string,archive_ref:string,supports:array<string>>>, fabrications array<struct<text:string,sensational:boolean>>"
)
RATINGS = "annotator string, corpus string, source string, gen_model string, responses array<struct<record_id:string,candidate_i:int,overall:int>>, notes map<string,string>"
AUTHORED = "author string, corpus string, source string, summaries array<struct<record_id:string,text:string,confidence:int>>"
CANDIDATES = (
    "corpus string, source string, gen_model string, k int, records array<struct<id:string,title:string,unit:string,register:string,record_block:string,prompt_user:string,"
    "picks:map<string,int>,candidates:array<struct<i:int,text:string,F:double,unsup:int,composite:double,linguistic:double,length_guard:double,guard_filtered:boolean,guard_reason:string,judge:double>>>>"
)
PAIRS = "prompt string, chosen string, rejected string, rejected_kind string, meta map<string,string>"
SFT = "prompt string, completion string, meta map<string,string>"
MANIFEST = "name string, description string, default_source string, sources map<string,struct<adapter:string,path:string,register:string,note:string>>"
