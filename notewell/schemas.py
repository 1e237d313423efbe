"""Schemas of the tables, of the extraction record and of the stored payload."""

from __future__ import annotations

from pyspark.sql import types as T


def parse(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


USERS = "id bigint, email string, full_name string, role string, score bigint, store string"
CLIENTS = (
    "id bigint, name string, external_client_id string, category string, vic_status string, "
    "total_spent double, sentiment_score double, total_interactions bigint, last_contact_date timestamp, "
    "days_since_contact int"
)
NOTES = (
    "id bigint, advisor_id bigint, client_id bigint, transcription string, analysis_json string, "
    "points_awarded int, timestamp timestamp, sentiment_score double"
)
FEEDBACK = (
    "id bigint, note_id bigint, advisor_id bigint, original_text string, predicted_tags_json string, "
    "corrected_tags_json string, corrections_json string, rating int, comment string, processing_tier int, "
    "actual_tier int, routing_correct boolean, created_at timestamp"
)
ACTIONS = (
    "note_id bigint, manager_id bigint, action_type string, status string, details string, "
    "created_at timestamp, updated_at timestamp"
)
PRODUCTS = (
    "sku string, name string, url string, image_url string, price_eur double, category1 string, "
    "category2 string, category3 string, is_discount boolean, stock int"
)
RAW_NOTES = "ID string, Date string, Duration string, Language string, Length int, Transcription string"
QUARANTINE = (
    "note_id string, note_text string, error string, tier_attempted string, retry_count int, "
    "timestamp string, requires_manual_review boolean, metadata string"
)

MATCHED_PRODUCT = (
    "struct<sku:string,name:string,category:string,price:double,url:string,image_url:string,"
    "in_stock:boolean,match_score:double,base_score:double,rerank_delta:double,query_used:string>"
)
NEXT_ACTION = (
    "struct<action_type:string,description:string,priority:string,target_products:array<string>,deadline:string>"
)
P1 = (
    "struct<categories:array<string>,produits_mentionnes:array<string>,usage:array<string>,"
    "preferences:struct<colors:array<string>,styles:array<string>,hardware:array<string>,materials:array<string>>,"
    f"matched_products:array<{MATCHED_PRODUCT}>>"
)
P2 = (
    "struct<purchase_context:struct<type:string,behavior:string>,profession:struct<sector:string,status:string>,"
    "lifestyle:struct<passions:array<string>,family:string>>"
)
P3 = (
    "struct<diet:array<string>,allergies:struct<food:array<string>,contact:array<string>>,"
    "values:array<string>,occasion:string>"
)
P4 = (
    f"struct<lead_temperature:string,next_best_action:{NEXT_ACTION},budget_potential:string,budget_specific:int,"
    "urgency:string,churn_risk:double,churn_level:string,clv_estimate:double,clv_tier:string,prediction_source:string>"
)
META = (
    "struct<confidence_score:double,missing_info:array<string>,risk_flags:array<string>,"
    "quality_score:double,completeness_score:double,advisor_feedback:string>"
)
PILLARS = ("pilier_1_univers_produit", "pilier_2_profil_client", "pilier_3_hospitalite_care", "pilier_4_action_business")
EXTRACTION = (
    f"struct<tags:array<string>,pilier_1_univers_produit:{P1},pilier_2_profil_client:{P2},"
    f"pilier_3_hospitalite_care:{P3},pilier_4_action_business:{P4},meta_analysis:{META},confidence:double>"
)
# numbers that may arrive as text stay strings until they are normalised
PAYLOAD = (
    "struct<id:string,routing:struct<tier:string,confidence:double,reasons:array<string>,priority:string>,"
    f"rgpd:struct<contains_sensitive:boolean,categories_detected:array<string>>,extraction:{EXTRACTION},"
    "processed_text:string,processing_time_ms:double,from_cache:boolean,cache_hit:boolean,quality_score:double,"
    "cost:double,metadata:struct<store_id:string,advisor_id:string>>"
)
FLAT_RESPONSE = (
    "struct<tags:array<string>,occasions:array<string>,usage_context:array<string>,colors:array<string>,"
    "materials:array<string>,client_status:string,profession:string,locations:array<string>,dietary:array<string>,"
    "allergies:array<string>,urgency:string,budget_tier:string,budget_range:string,confidence:double>"
)
NESTED_RESPONSE = (
    f"struct<pilier_1_univers_produit:{P1},pilier_2_profil_client:{P2},pilier_3_hospitalite_care:{P3},"
    f"pilier_4_action_business:{P4},meta_analysis:{META}>"
)
SPAN = (
    "struct<class:string,text:string,attributes:struct<categorie:string,marque:string,budget:string,statut:string,"
    "occasion:string,type_action:string,urgence:string>,char_start:int,char_end:int>"
)
DRIFT_PAYLOAD = (
    "struct<produits:array<string>,categories:array<string>,materiaux:array<string>,couleurs:array<string>,"
    "profil_client:struct<is_vip:boolean,budget:string,contextes:array<string>,preferences:array<string>>,"
    "hospitalite:struct<occasions:array<string>>,"
    "action:struct<next_best_action:string,urgence:double,recommandations:array<string>>,confidence:double>"
)
STEP_EVENT = "step string, note_id bigint, user_id bigint, profile string, tier int, value double, ts timestamp"
