"""Tables that must equal the rules being audited against. Everything here is data, in natural order."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, SparkSession

# --- Fixed values: header words and the field that each means (field: words).
FIELD_WORDS = {
    "event_id": ["event id", "event_id"],
    "event_line_id": ["event line id", "event_line_id"],
    "event_type": ["event type", "event_type"],
    "event_datetime": ["event date", "event datetime", "event_datetime"],
    "date_you_shipped_the_food": ["ship date", "shipping date", "date shipped", "date_you_shipped_the_food"],
    "received_date": ["receive date", "received date"],
    "traceability_lot_code": ["lot", "lot #", "lot number", "lot_or_tlc", "tlc", "traceability lot code", "traceability_lot_code"],
    "source_lot_or_tlc": ["source_lot_or_tlc", "source lot", "source tlc"],
    "output_lot_or_tlc": ["output_lot_or_tlc", "output lot", "output tlc"],
    "target_lot_or_tlc": ["target_lot_or_tlc", "target lot"],
    "product_name": ["product", "product name", "product_name", "item"],
    "product_id": ["product_id"],
    "quantity": ["quantity"],
    "unit": ["unit"],
    "ftl_category": ["ftl_category", "ftl_food_category"],
    "is_ftl_maybe": ["is_ftl_maybe"],
    "food_form": ["food form", "form"],
    "destination_type": ["destination", "destination type", "destination_type", "customer type"],
    "actor_location_id": ["actor_location_id"],
    "location_id": ["location_id"],
    "location_name": ["location_name"],
    "location_type": ["location_type"],
    "partner_id": ["partner_id"],
    "partner_name": ["partner_name"],
    "partner_type": ["partner_type"],
    "partner_relationship": ["relationship"],
    "from_partner_id": ["from_partner_id"],
    "to_partner_id": ["to_partner_id"],
    "business_id": ["business_id"],
    "business_type": ["business_type"],
    "company_name": ["company_name"],
    "handles_ftl_foods": ["handles_ftl_foods"],
    "covered_entity_status": ["covered_entity_status"],
    "reference_record_type": ["reference_record_type"],
    "reference_record_no": ["reference_record_no"],
    "source_document_id": ["evidence_id"],
    "source_document_type": ["evidence_type"],
    "source_document_status": ["evidence_status"],
    "exemption_claim_id": ["claim_id"],
    "exemption_claim_type": ["claim_type"],
    "exemption_claimed_by": ["claimed_by"],
    "exemption_evidence_provided": ["evidence_provided"],
    "traceability_plan_item": ["plan_item"],
    "traceability_plan_answer": ["answer"],
    "kde_id": ["kde_id"],
    "cte_type": ["cte_type"],
    "kde_name": ["kde_name"],
    "kde_field_key": ["field_key"],
    "kde_value": ["kde_value"],
    "lineage_id": ["lineage_id"],
    "relationship_type": ["relationship_type"],
    "lineage_status": ["lineage_status"],
}

# --- Fixed values: values that count as absent.
PLACEHOLDERS = [
    "", "unknown", "n/a", "n.a.", "na", "tbd", "tbc", "none", "null", "-", "--", "pending", "not provided", "not available", "unassigned", "missing",
]

# --- Fixed values: spellings of units.
UNITS = {"lbs": "lb", "pounds": "lb", "pound": "lb", "kgs": "kg", "kilograms": "kg", "kilogram": "kg", "cases": "case", "cs": "case", "each": "each", "ea": "each"}

# --- Fixed values: event types, the order of their precedence, and the score (in hundredths) that each needs.
CTE_ORDER = [
    "traceability_plan", "first_land_based_receiving", "harvesting", "cooling", "initial_packing", "transformation", "shipping", "receiving",
]
CTE_NEEDED = {"shipping": 55, "receiving": 50, "transformation": 40}
CTE_NEEDED_OTHERS = 45

# --- Fixed values: spellings of event types when evidence is assembled, and when events are classified.
EVIDENCE_CTE = {
    "harvest": "harvesting", "harvesting": "harvesting", "cool": "cooling", "cooling": "cooling", "pack": "initial_packing", "packing": "initial_packing",
    "initial packing": "initial_packing", "initial_packing": "initial_packing", "first land based receiving": "first_land_based_receiving",
    "first_land_based_receiving": "first_land_based_receiving", "first land": "first_land_based_receiving", "ship": "shipping", "shipping": "shipping",
    "receive": "receiving", "receiving": "receiving", "transform": "transformation", "transformation": "transformation", "traceability plan": "traceability_plan",
}
CLASSIFIER_CTE = {
    "harvest": "harvesting", "harvesting": "harvesting", "cool": "cooling", "cooling": "cooling", "pack": "initial_packing", "packing": "initial_packing",
    "initial packing": "initial_packing", "first land based receiving": "first_land_based_receiving", "first land": "first_land_based_receiving",
    "ship": "shipping", "shipping": "shipping", "receive": "receiving", "receiving": "receiving", "traceability plan": "traceability_plan",
}

# --- Fixed values: words of transformation, of movement documents that don't prove shipping, and of the classifier's rules.
TRANSFORMATION_WORDS = [
    "transform", "transforms", "transformed", "transforming", "transformation", "process", "processing", "processed", "manufacture", "manufacturing",
    "manufactured", "repack", "repacking", "repacked", "blend", "blending", "blended", "mix", "mixing", "mixed", "commingle", "commingling",
    "commingled", "cut", "cutting", "fresh-cut", "slice", "slicing", "sliced", "dice", "dicing", "diced", "shred", "shredding", "shredded",
    "fresh cut",
]
WEAK_MOVEMENT = [
    "delivery note", "delivery notification", "dispatch advice", "movement record", "transfer order", "inventory movement", "stock movement",
    "goods movement", "carrier manifest", "freight bill", "waybill", "proof of delivery", "delivery receipt",
]
CONSUMER_WORDS = ["direct to consumer", "consumer", "dtc"]
CARRIER_WORDS = ["carrier", "trucker", "logistics provider", "freight", "3pl", "hauler", "transport-only"]
RETURN_WORDS = [
    "return", "reversal", "correction", "void", "adjustment", "error declaration", "was incorrect", "incorrect event", "incorrect record", "credit memo",
    "credit note", " rma ", "recall", "rejected", "rejection", "damaged", "spoiled", "write-off", "write off", "disposal",
]
EXEMPT_WORDS = ["kill", "exemption", "exempt", "partial"]

# --- Fixed values: evidence for an event type by document type and by actor role.
DOCUMENT_CTE = {
    "shipping_log": "shipping", "bill_of_lading": "shipping", "receiving_log": "receiving", "seafood_landing_record": "first_land_based_receiving",
    "transformation_batch_record": "transformation", "harvest_log": "harvesting", "cooling_log": "cooling", "packing_log": "initial_packing",
    "traceability_plan": "traceability_plan",
}
ROLE_CTE = {
    "shipper": "shipping", "receiver": "receiving", "first_land_based_receiver": "first_land_based_receiving", "processor": "transformation",
    "harvester": "harvesting", "cooler": "cooling", "initial_packer": "initial_packing",
}

# --- Fixed values: actor roles and their words, first match wins; and roles by event type.
ROLE_WORDS = [
    ("first_land_based_receiver", ["first land", "landing", "seafood receiver"]),
    ("initial_packer", ["initial pack", "packing house", "packer"]),
    ("harvester", ["harvest", "harvester"]),
    ("cooler", ["cooler", "cooling"]),
    ("farm", ["farm", "grower", "ranch"]),
    ("processor", ["processor", "processing", "manufacturer", "kitchen", "commissary"]),
    ("restaurant_rfe", ["restaurant", "retail food", "rfe", "store"]),
    ("distributor", ["distributor", "warehouse", "dc"]),
    ("transporter", ["carrier", "transporter", "truck", "freight"]),
    ("consumer", ["consumer", "direct to consumer", "dtc"]),
    ("shipper", ["shipper", "seller"]),
    ("receiver", ["receiver", "buyer"]),
]
CTE_ROLE = {
    "shipping": "shipper", "receiving": "receiver", "transformation": "processor", "first_land_based_receiving": "first_land_based_receiver",
    "initial_packing": "initial_packer", "harvesting": "harvester",
}

# --- Fixed values: document types and their words; the most words win, the first on ties.
DOCUMENT_WORDS = [
    ("invoice", ["invoice", "inv #", "inv-", "bill to"]),
    ("bill_of_lading", ["bill of lading", "bol", "freight", "carrier"]),
    ("receiving_log", ["receiving", "received", "receipt"]),
    ("shipping_log", ["shipping", "shipped", "ship date", "dispatch"]),
    ("transformation_batch_record", ["batch", "transformation", "production", "work order", "recipe"]),
    ("harvest_log", ["harvest", "field", "grower"]),
    ("cooling_log", ["cooling", "cooler", "temperature"]),
    ("packing_log", ["packing", "pack date", "packing house"]),
    ("seafood_landing_record", ["first land", "landing", "vessel", "dock", "landing ticket"]),
    ("traceability_plan", ["traceability plan", "record maintenance", "point of contact"]),
]

# --- Fixed values: states of a food and their words, the states that end its listing, and produce that is taken as fresh.
FORM_WORDS = [
    ("fresh_cut", ["fresh-cut", "fresh cut"]),
    ("fresh", ["fresh"]),
    ("frozen", ["frozen"]),
    ("previously_frozen", ["previously frozen"]),
    ("canned", ["canned"]),
    ("shelf_stable", ["shelf stable", "ambient temperature", "shelf-stable"]),
    ("aseptic", ["aseptic"]),
    ("refrigerated", ["refrigerated", "chilled"]),
    ("cooked", ["cooked", "baked", "roasted"]),
    ("kill_step_applied", ["kill step", "pasteurized", "validated lethality"]),
    ("raw_agricultural_commodity", ["raw agricultural commodity", "rac"]),
    ("seafood_from_fishing_vessel", ["fishing vessel", "vessel", "seafood"]),
]
UNLISTED_FORMS = ["canned", "shelf_stable", "aseptic"]
FRESH_PRODUCE = ["basil", "lettuce", "cucumber", "sprout", "tomato", "melon", "pepper"]

# --- Fixed values: contracts. For each required record element: event type, section, name, label, fields (any of which meets it), requirement, severity.
CONTRACT_ROWS = [
    ("shipping", "21 CFR 1.1340", "traceability_lot_code", "Traceability Lot Code (TLC)", ["traceability_lot_code"], "required", "high"),
    ("shipping", "21 CFR 1.1340", "quantity", "quantity and unit of measure", ["quantity"], "required", "medium"),
    ("shipping", "21 CFR 1.1340", "product_description", "product description", ["product_name"], "required", "medium"),
    ("shipping", "21 CFR 1.1340", "ship_to_location", "location of the immediate subsequent recipient (ship-to)", ["to_partner_id"], "required", "medium"),
    ("shipping", "21 CFR 1.1340", "ship_from_location", "location the food was shipped from", ["from_partner_id", "actor_location_id"], "required", "medium"),
    ("shipping", "21 CFR 1.1340", "ship_date", "date you shipped the food", ["event_datetime"], "required", "medium"),
    ("shipping", "21 CFR 1.1340", "reference_document_type", "reference document type", ["reference_record_type"], "required", "medium"),
    ("shipping", "21 CFR 1.1340", "reference_document_number", "reference document number", ["reference_record_no", "reference_document_number"], "required", "medium"),
    ("shipping", "21 CFR 1.1340", "tlc_source", "traceability lot code source / source reference", ["tlc_source", "source_lot_or_tlc", "reference_record_no", "reference_document_number"], "conditional", "medium"),
    ("receiving", "21 CFR 1.1345", "traceability_lot_code", "Traceability Lot Code (TLC)", ["traceability_lot_code"], "required", "high"),
    ("receiving", "21 CFR 1.1345", "quantity", "quantity and unit of measure", ["quantity"], "required", "medium"),
    ("receiving", "21 CFR 1.1345", "product_description", "product description", ["product_name"], "required", "medium"),
    ("receiving", "21 CFR 1.1345", "previous_source_location", "location of the immediate previous source", ["from_partner_id"], "required", "medium"),
    ("receiving", "21 CFR 1.1345", "received_location", "location where the food was received", ["actor_location_id", "to_partner_id"], "required", "medium"),
    ("receiving", "21 CFR 1.1345", "received_date", "date you received the food", ["event_datetime"], "required", "medium"),
    ("receiving", "21 CFR 1.1345", "reference_document_type", "reference document type", ["reference_record_type"], "required", "medium"),
    ("receiving", "21 CFR 1.1345", "reference_document_number", "reference document number", ["reference_record_no", "reference_document_number"], "required", "medium"),
    ("receiving", "21 CFR 1.1345", "tlc_source", "traceability lot code source / source reference", ["tlc_source", "source_lot_or_tlc", "reference_record_no", "reference_document_number"], "conditional", "medium"),
    ("transformation", "21 CFR 1.1350", "output_lot_or_tlc", "new Traceability Lot Code for the transformed food", ["output_lot_or_tlc"], "required", "high"),
    ("transformation", "21 CFR 1.1350", "source_lot_or_tlc", "Traceability Lot Code of each input lot", ["source_lot_or_tlc"], "required", "high"),
    ("transformation", "21 CFR 1.1350", "product_description", "product description", ["product_name"], "required", "medium"),
    ("transformation", "21 CFR 1.1350", "quantity", "quantity and unit of measure", ["quantity"], "required", "medium"),
    ("transformation", "21 CFR 1.1350", "transformation_location", "location where you transformed the food (TLC source)", ["actor_location_id"], "required", "medium"),
    ("transformation", "21 CFR 1.1350", "transformation_date", "date transformation was completed", ["event_datetime"], "required", "medium"),
    ("transformation", "21 CFR 1.1350", "reference_document_type", "reference document type", ["reference_record_type"], "required", "medium"),
    ("transformation", "21 CFR 1.1350", "reference_document_number", "reference document number", ["reference_record_no"], "required", "medium"),
    ("initial_packing", "21 CFR 1.1330", "traceability_lot_code", "Traceability Lot Code assigned at packing", ["traceability_lot_code", "output_lot_or_tlc"], "required", "high"),
    ("initial_packing", "21 CFR 1.1330", "product_description", "product description of the packed food", ["product_name"], "required", "medium"),
    ("initial_packing", "21 CFR 1.1330", "quantity", "quantity and unit of measure", ["quantity"], "required", "medium"),
    ("initial_packing", "21 CFR 1.1330", "packing_date", "date of initial packing", ["event_datetime"], "required", "medium"),
    ("initial_packing", "21 CFR 1.1330", "reference_document_type", "reference document type", ["reference_record_type"], "required", "medium"),
    ("initial_packing", "21 CFR 1.1330", "reference_document_number", "reference document number", ["reference_record_no"], "required", "medium"),
    ("initial_packing", "21 CFR 1.1330", "harvest_farm_location", "farm where the food was harvested", ["harvest_farm_location", "farm_location"], "required", "medium"),
    ("initial_packing", "21 CFR 1.1330", "harvest_field_or_container", "field/growing-area or aquaculture container name", ["harvest_field_or_container", "growing_area", "container_name"], "conditional", "medium"),
    ("initial_packing", "21 CFR 1.1330", "harvester_contact", "harvester business name and phone", ["harvester_contact", "harvester_name", "harvester_phone"], "required", "medium"),
    ("first_land_based_receiving", "21 CFR 1.1335", "traceability_lot_code", "Traceability Lot Code assigned at first land-based receiving", ["traceability_lot_code"], "required", "high"),
    ("first_land_based_receiving", "21 CFR 1.1335", "product_description", "species / acceptable market name / product description", ["product_name"], "required", "medium"),
    ("first_land_based_receiving", "21 CFR 1.1335", "quantity", "quantity and unit of measure", ["quantity"], "required", "medium"),
    ("first_land_based_receiving", "21 CFR 1.1335", "landed_date", "date the food was landed", ["event_datetime"], "required", "medium"),
    ("first_land_based_receiving", "21 CFR 1.1335", "reference_document_type", "reference document type", ["reference_record_type"], "required", "medium"),
    ("first_land_based_receiving", "21 CFR 1.1335", "reference_document_number", "reference document number", ["reference_record_no"], "required", "medium"),
    ("first_land_based_receiving", "21 CFR 1.1335", "harvest_range_and_locations", "harvest date range and geographic catch locations", ["harvest_range_and_locations", "catch_location", "harvest_date_range"], "required", "medium"),
    ("harvesting", "21 CFR 1.1325", "product_description", "commodity / product description", ["product_name"], "required", "medium"),
    ("harvesting", "21 CFR 1.1325", "quantity", "quantity and unit of measure", ["quantity"], "required", "medium"),
    ("harvesting", "21 CFR 1.1325", "subsequent_recipient_location", "location of the immediate subsequent recipient", ["to_partner_id"], "required", "medium"),
    ("harvesting", "21 CFR 1.1325", "harvest_date", "date of harvesting", ["event_datetime"], "required", "medium"),
    ("harvesting", "21 CFR 1.1325", "reference_document_type", "reference document type", ["reference_record_type"], "required", "medium"),
    ("harvesting", "21 CFR 1.1325", "reference_document_number", "reference document number", ["reference_record_no"], "required", "medium"),
    ("harvesting", "21 CFR 1.1325", "harvest_farm_location", "farm where the food was harvested", ["harvest_farm_location", "farm_location"], "required", "medium"),
    ("harvesting", "21 CFR 1.1325", "harvest_field_or_container", "field/growing-area or aquaculture container name", ["harvest_field_or_container", "growing_area", "container_name"], "conditional", "medium"),
    ("cooling", "21 CFR 1.1325", "product_description", "commodity / product description", ["product_name"], "required", "medium"),
    ("cooling", "21 CFR 1.1325", "quantity", "quantity and unit of measure", ["quantity"], "required", "medium"),
    ("cooling", "21 CFR 1.1325", "subsequent_recipient_location", "location of the immediate subsequent recipient", ["to_partner_id"], "required", "medium"),
    ("cooling", "21 CFR 1.1325", "cooling_location", "location where you cooled the food", ["actor_location_id"], "required", "medium"),
    ("cooling", "21 CFR 1.1325", "cooling_date", "date of cooling", ["event_datetime"], "required", "medium"),
    ("cooling", "21 CFR 1.1325", "reference_document_type", "reference document type", ["reference_record_type"], "required", "medium"),
    ("cooling", "21 CFR 1.1325", "reference_document_number", "reference document number", ["reference_record_no"], "required", "medium"),
]
CONTRACT_SECTIONS = {cte: section for cte, section, *_ in CONTRACT_ROWS}

# --- Fixed values: exemption types, their other names, and what an exemption does.
EXEMPTIONS = [
    ("small_producer", ["small producer", "small_producer", "small farm", "produce safety small"], "full"),
    ("farm_direct_to_consumer", ["direct to consumer", "direct_to_consumer", "dtc", "farm direct", "direct marketing"], "full"),
    ("food_changed_no_longer_ftl", ["kill step", "kill_step", "food changed", "no longer on ftl", "commercially sterile", "retort"], "partial"),
    ("rarely_consumed_raw_produce", ["rarely consumed raw", "rarely_consumed_raw"], "full"),
    ("non_ftl_product", ["non ftl", "non_ftl", "not on ftl", "non_ftl_product", "out of scope food"], "out_of_scope"),
    ("usda_regulated", ["usda", "usda regulated", "meat poultry egg", "fsis"], "full"),
    ("transporter", ["transporter", "carrier", "3pl", "freight"], "full"),
    ("nonprofit_food_establishment", ["nonprofit", "non-profit", "food bank", "charity"], "full"),
    ("retail_food_establishment_restaurant", ["retail food establishment", "restaurant", "rfe", "retail"], "partial"),
    ("fishing_vessel", ["fishing vessel", "fishing_vessel"], "partial"),
]
EVIDENCED_ANSWERS = ["yes", "y", "true", "1", "provided", "attached"]

# --- Fixed values: parts of a traceability plan, the words that find each, and whether only farms need it.
PLAN_PARTS = [
    ("record_maintenance_procedures", ["record_maintenance_procedure"], False),
    ("ftl_food_identification", ["ftl_identification_procedure"], False),
    ("tlc_assignment_procedure", ["tlc_assignment_procedure"], False),
    ("point_of_contact", ["point_of_contact"], False),
    ("farm_map", ["farm_map_available"], True),
    ("plan_update_and_retention", ["plan_update", "retention", "previous plan"], False),
]
FARM_CTES = ["harvesting", "cooling", "initial_packing"]

# --- Fixed values: fields whose absence is the root cause of a finding, fields of high severity, and queues by finding.
LOT_FIELDS = ["traceability_lot_code", "output_lot_or_tlc", "source_lot_or_tlc"]
HIGH_FIELDS = ["traceability_lot_code", "output_lot_or_tlc"]
QUEUES = {
    "kde_completeness": "missing_kde", "tlc_lineage": "tlc_gap", "traceability_plan": "traceability_plan_gap",
    "sortable_export_readiness": "export_blocker", "exemption_claim": "exemption_review",
}
SEVERITY_RANK = ["critical", "high", "medium", "low"]


def field_aliases(spark: SparkSession) -> DataFrame:
    rows = [(word, field) for field, words in FIELD_WORDS.items() for word in words]
    return spark.createDataFrame(rows, "alias string, field_key string")


def contracts(spark: SparkSession) -> DataFrame:
    """(cte, section, ordinal, kde, label, satisfied_by, requirement, severity): one row per record element."""
    seen = Counter()
    rows = []
    for cte, section, *element in CONTRACT_ROWS:
        seen[cte] += 1
        rows.append((cte, section, seen[cte], *element))
    return spark.createDataFrame(
        rows, "cte string, section string, ordinal int, kde string, label string, satisfied_by array<string>, requirement string, severity string"
    )


def exemptions(spark: SparkSession) -> DataFrame:
    rows = [(k, name, words, effect) for k, (name, words, effect) in enumerate(EXEMPTIONS, 1)]
    return spark.createDataFrame(rows, "ordinal int, exemption_type string, aliases array<string>, effect string")


def plan_parts(spark: SparkSession) -> DataFrame:
    rows = [(k, name, words, farm) for k, (name, words, farm) in enumerate(PLAN_PARTS, 1)]
    return spark.createDataFrame(rows, "ordinal int, component string, match_terms array<string>, farm_only boolean")
