"""Explicit schemas of stored relations: readers never infer, writers check what they write (S1, S11); ``admission`` judges rows by them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Columns of each relation; structs whose shape a caller chooses are JSON text.
SCHEMAS = {
    "structures": "id string NOT NULL, external_structure_number string, name string, road string, country_code string, federal_state string, district string, municipality string, locality string, postal_code string, stationing string, crossed_feature string, latitude decimal(9,6), longitude decimal(10,6), owner string, load_bearing_responsibility string, responsible_authority string, maintenance_office string, data_origin string, created_at timestamp NOT NULL, updated_at timestamp NOT NULL",
    "partial_structures": "id string NOT NULL, structure_id string NOT NULL, external_partial_structure_number string, name string, construction_year int, structure_type string, structural_system string, length_m decimal(12,3), width_m decimal(12,3), area_sq_m decimal(14,3), clear_height_m decimal(12,3), span_count int, created_at timestamp NOT NULL, updated_at timestamp NOT NULL",
    "inspections": "id string NOT NULL, structure_id string NOT NULL, partial_structure_id string NOT NULL, type string, inspected_on date, inspector string, condition_score decimal(2,1), cycle_months int, created_at timestamp NOT NULL, updated_at timestamp NOT NULL",
    "components": "id string NOT NULL, structure_id string NOT NULL, partial_structure_id string NOT NULL, type string, name string, location string, material string, construction_year int, install_year int, additional_properties map<string,string>, created_at timestamp NOT NULL, updated_at timestamp NOT NULL",
    "findings": "id string NOT NULL, structure_id string NOT NULL, partial_structure_id string NOT NULL, inspection_id string NOT NULL, component_id string, source_identifier string, defect_type string, description string, location string, extent string, dimension_length decimal(14,3), dimension_width decimal(14,3), dimension_depth decimal(14,3), dimension_unit string, quantity decimal(16,3), quantity_unit string, stability_rating int, traffic_safety_rating int, durability_rating int, status string, created_at timestamp NOT NULL, updated_at timestamp NOT NULL",
    "recommendations": "id string NOT NULL, structure_id string NOT NULL, partial_structure_id string NOT NULL, work_type string, description string, urgency string, quantity decimal(16,3), unit string, source_estimated_cost decimal(16,2), source_estimated_cost_currency string, target_year int, planned_year int, status string, created_at timestamp NOT NULL, updated_at timestamp NOT NULL",
    "recommendation_findings": "structure_id string NOT NULL, partial_structure_id string NOT NULL, recommendation_id string NOT NULL, finding_id string NOT NULL, created_at timestamp NOT NULL, updated_at timestamp NOT NULL",
    "planned_interventions": "id string NOT NULL, recommendation_id string NOT NULL, structure_id string NOT NULL, partial_structure_id string NOT NULL, work_type string NOT NULL, planned_year int NOT NULL, quantity decimal(16,3), unit string, estimated_cost decimal(16,2), estimated_cost_currency string, estimated_cost_source string, estimated_cost_status string, status string NOT NULL, created_at timestamp NOT NULL, updated_at timestamp NOT NULL",
    "budget_programs": "id string NOT NULL, planning_year int NOT NULL, approved_budget_amount decimal(16,2), currency string, created_at timestamp NOT NULL, updated_at timestamp NOT NULL",
    "budget_program_interventions": "budget_program_id string NOT NULL, intervention_id string NOT NULL, planning_year int NOT NULL, created_at timestamp NOT NULL, updated_at timestamp NOT NULL",
    "budget_scenarios": "id string NOT NULL, name string NOT NULL, status string NOT NULL, horizon_start_year int NOT NULL, horizon_years int NOT NULL, currency string NOT NULL, adopted_at timestamp, created_at timestamp NOT NULL, updated_at timestamp NOT NULL",
    "budget_scenario_envelopes": "scenario_id string NOT NULL, planning_year int NOT NULL, approved_budget_amount decimal(16,2), currency string, created_at timestamp NOT NULL, updated_at timestamp NOT NULL",
    "budget_scenario_assignments": "scenario_id string NOT NULL, intervention_id string NOT NULL, assigned_year int, assignment_source string NOT NULL, created_at timestamp NOT NULL, updated_at timestamp NOT NULL",
    "work_packages": "id string NOT NULL, planned_intervention_id string NOT NULL, recommendation_id string NOT NULL, structure_id string NOT NULL, partial_structure_id string NOT NULL, title string NOT NULL, status string NOT NULL, snapshot_version int NOT NULL, snapshot string NOT NULL, generated_at timestamp NOT NULL, created_at timestamp NOT NULL, updated_at timestamp NOT NULL",
    "historical_works": "id string NOT NULL, structure_id string NOT NULL, partial_structure_id string, type string, title string, reason string, contractor string, client string, started_on date, ended_on date, quantity decimal(16,3), unit string, contract_amount decimal(16,2), final_amount decimal(16,2), currency string, created_at timestamp NOT NULL, updated_at timestamp NOT NULL",
    "traffic_observations": "id string NOT NULL, structure_id string NOT NULL, observation_year int NOT NULL, observed_on date, daily_traffic int, heavy_vehicle_daily int, truck_share_percent decimal(5,2), source string NOT NULL, source_description string, created_at timestamp NOT NULL, updated_at timestamp NOT NULL",
    "environmental_metrics": "id string NOT NULL, structure_id string NOT NULL, observation_year int NOT NULL, latitude decimal(9,6), longitude decimal(10,6), grid_latitude decimal(9,6), grid_longitude decimal(10,6), elevation_m decimal(8,1), freeze_thaw_days int, frost_days int, ice_days int, wet_dry_cycles int, mean_relative_humidity_percent decimal(5,1), precipitation_hours int, heavy_rain_days_20 int, heavy_rain_days_30 int, annual_precip_mm decimal(8,1), deicing_days int, monthly_precip_mm array<double>, monthly_freeze_thaw_days array<double>, source string NOT NULL, source_description string, formula_version string NOT NULL, created_at timestamp NOT NULL, updated_at timestamp NOT NULL",
    "network_metrics": "id string NOT NULL, structure_id string NOT NULL, observation_year int NOT NULL, latitude decimal(9,6), longitude decimal(10,6), carried_road string, road_class string NOT NULL, traffic_applies_to string NOT NULL, normal_trip_km decimal(8,1), closure_detour_km decimal(8,1), additional_distance_km decimal(8,1), alternative_crossing_count int, on_strategic_network boolean NOT NULL, source string NOT NULL, source_description string, formula_version string NOT NULL, created_at timestamp NOT NULL, updated_at timestamp NOT NULL",
    "hydrological_metrics": "id string NOT NULL, structure_id string NOT NULL, station_uuid string NOT NULL, station_name string NOT NULL, station_number string, water_name string NOT NULL, river_km decimal(8,3), latitude decimal(9,6), longitude decimal(10,6), distance_km decimal(6,1), observed_at timestamp NOT NULL, water_level_cm int NOT NULL, unit string NOT NULL, state_mnw_mhw string, state_nsw_hsw string, mhw_cm int, hsw_cm int, hhw_cm int, mnw_cm int, mw_cm int, marke_i_cm int, marke_ii_cm int, inspection_trigger_cm int NOT NULL, source string NOT NULL, source_description string, formula_version string NOT NULL, created_at timestamp NOT NULL, updated_at timestamp NOT NULL",
    "hydrological_flood_events": "id string NOT NULL, structure_id string NOT NULL, event_year int NOT NULL, peaked_on date NOT NULL, peak_water_level_cm int NOT NULL, station_uuid string NOT NULL, station_name string NOT NULL, water_name string NOT NULL, mhw_cm int, hsw_cm int, hhw_cm int, marke_i_cm int, marke_ii_cm int, source string NOT NULL, source_description string, created_at timestamp NOT NULL, updated_at timestamp NOT NULL",
    "documents": "id string NOT NULL, structure_id string, partial_structure_id string, type string NOT NULL, original_filename string NOT NULL, status string NOT NULL, checksum_sha256 string, mime_type string, size_bytes bigint, storage_key string, photo_storage_key string, photo_mime_type string, photo_page_number int, photo_byte_size bigint, metadata map<string,string>, created_at timestamp NOT NULL, updated_at timestamp NOT NULL",
    "document_processing_runs": "id string NOT NULL, document_id string NOT NULL, status string NOT NULL, parser string, page_count int, error_code string, error_message string, parsing_started_at timestamp, parsing_completed_at timestamp, created_at timestamp NOT NULL, updated_at timestamp NOT NULL",
    "document_pages": "document_id string NOT NULL, page_number int NOT NULL, text_content string NOT NULL, text_source string NOT NULL, created_at timestamp NOT NULL, updated_at timestamp NOT NULL",
    "document_extraction_runs": "id string NOT NULL, document_id string NOT NULL, processing_run_id string NOT NULL, retry_of_run_id string, attempt int NOT NULL, status string NOT NULL, pipeline_version string NOT NULL, prompt_versions map<string,string> NOT NULL, provider string NOT NULL, model string NOT NULL, temperature decimal(3,2) NOT NULL, output_structure_id string, duration_ms int, input_tokens int, output_tokens int, estimated_cost decimal(14,6), cost_currency string, result_summary string, error_stage string, error_code string, error_message string, started_at timestamp, completed_at timestamp, created_at timestamp NOT NULL, updated_at timestamp NOT NULL",
    "extraction_entity_bindings": "id string NOT NULL, document_id string NOT NULL, entity_kind string NOT NULL, source_identity_key string NOT NULL, entity_id string NOT NULL, latest_run_id string NOT NULL, last_applied_fingerprint string NOT NULL, created_at timestamp NOT NULL, updated_at timestamp NOT NULL",
    "document_extraction_invocations": "id string NOT NULL, run_id string NOT NULL, document_id string NOT NULL, stage string NOT NULL, category string, page_numbers array<int> NOT NULL, prompt_version string NOT NULL, provider string NOT NULL, model string NOT NULL, status string NOT NULL, provider_request_id string, duration_ms int, input_tokens int, output_tokens int, estimated_cost decimal(14,6), cost_currency string, error_code string, error_message string, started_at timestamp NOT NULL, completed_at timestamp, created_at timestamp NOT NULL, updated_at timestamp NOT NULL",
    "document_page_classifications": "run_id string NOT NULL, document_id string NOT NULL, invocation_id string NOT NULL, page_number int NOT NULL, category string NOT NULL, confidence decimal(4,3) NOT NULL, section_title string, created_at timestamp NOT NULL",
    "source_evidence": "id string NOT NULL, document_id string NOT NULL, extraction_run_id string, page_number int, source_excerpt string, bounding_box_x decimal(8,6), bounding_box_y decimal(8,6), bounding_box_width decimal(8,6), bounding_box_height decimal(8,6), extraction_confidence decimal(4,3), extraction_method string NOT NULL, review_state string, created_at timestamp NOT NULL, updated_at timestamp NOT NULL",
    "structure_evidence": "structure_id string NOT NULL, evidence_id string NOT NULL, field_name string NOT NULL, kind string NOT NULL, derivation_method string, created_at timestamp NOT NULL",
    "partial_structure_evidence": "partial_structure_id string NOT NULL, evidence_id string NOT NULL, field_name string NOT NULL, kind string NOT NULL, derivation_method string, created_at timestamp NOT NULL",
    "component_evidence": "component_id string NOT NULL, evidence_id string NOT NULL, field_name string NOT NULL, kind string NOT NULL, derivation_method string, created_at timestamp NOT NULL",
    "inspection_evidence": "inspection_id string NOT NULL, evidence_id string NOT NULL, field_name string NOT NULL, kind string NOT NULL, derivation_method string, created_at timestamp NOT NULL",
    "finding_evidence": "finding_id string NOT NULL, evidence_id string NOT NULL, field_name string NOT NULL, kind string NOT NULL, derivation_method string, created_at timestamp NOT NULL",
    "recommendation_evidence": "recommendation_id string NOT NULL, evidence_id string NOT NULL, field_name string NOT NULL, kind string NOT NULL, derivation_method string, created_at timestamp NOT NULL",
    "historical_work_evidence": "historical_work_id string NOT NULL, evidence_id string NOT NULL, field_name string NOT NULL, kind string NOT NULL, derivation_method string, created_at timestamp NOT NULL",
    "traffic_observation_evidence": "traffic_observation_id string NOT NULL, evidence_id string NOT NULL, field_name string NOT NULL, kind string NOT NULL, derivation_method string, created_at timestamp NOT NULL",
}


def schema(relation: str) -> StructType:
    return StructType.fromDDL(SCHEMAS[relation])


def read(spark: SparkSession, path: str, relation: str, source: str = "parquet") -> DataFrame:
    """A stored relation with its own schema; columns that a file lacks are null."""
    return spark.read.schema(schema(relation)).format(source).load(path)


def checked(df: DataFrame, relation: str) -> DataFrame:
    """``df`` with exactly the relation's columns in order; a missing column or another type raises ValueError."""
    have = dict(df.dtypes)
    wrong = [f.name for f in schema(relation) if have.get(f.name) != f.dataType.simpleString()]
    if wrong:
        raise ValueError(f"{relation}: missing or of another type: {', '.join(wrong)}")
    return df.select(*[f.name for f in schema(relation)])


def write(df: DataFrame, path: str, relation: str, sink: str = "parquet") -> None:
    """A new version of a relation; an existing one is never overwritten in place."""
    checked(df, relation).write.format(sink).mode("error").save(path)


def book_files(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of a folder as bytes with their checksum, the source of a page parser; in order of their names."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(folder)
    return files.selectExpr("regexp_extract(path, '[^/]+$', 0) AS original_filename", "length AS size_bytes", "sha2(content, 256) AS checksum_sha256", "content").orderBy("original_filename")
