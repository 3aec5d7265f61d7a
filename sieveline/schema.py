"""The nested profile record and the query that ranks it."""

from __future__ import annotations

from dataclasses import dataclass

#: Nested record of one profile; parts that are missing read as null.
PROFILE_DDL = """
candidate_id STRING,
profile STRUCT<anonymized_name STRING, headline STRING, summary STRING, location STRING, country STRING,
  years_of_experience DOUBLE, current_title STRING, current_company STRING, current_company_size STRING,
  current_industry STRING>,
career_history ARRAY<STRUCT<company STRING, title STRING, start_date STRING, end_date STRING, duration_months INT,
  is_current BOOLEAN, industry STRING, company_size STRING, description STRING>>,
education ARRAY<STRUCT<institution STRING, degree STRING, field_of_study STRING, start_year INT, end_year INT,
  grade STRING, tier STRING>>,
skills ARRAY<STRUCT<name STRING, proficiency STRING, endorsements INT, duration_months INT>>,
certifications ARRAY<STRUCT<name STRING, issuer STRING, year INT>>,
languages ARRAY<STRUCT<language STRING, proficiency STRING>>,
{signals} STRUCT<profile_completeness_score DOUBLE, signup_date STRING, last_active_date STRING,
  open_to_work_flag BOOLEAN, profile_views_received_30d INT, applications_submitted_30d INT,
  recruiter_response_rate DOUBLE, avg_response_time_hours DOUBLE, skill_assessment_scores MAP<STRING, DOUBLE>,
  connection_count INT, endorsements_received INT, notice_period_days INT,
  expected_salary_range_inr_lpa STRUCT<min: DOUBLE, max: DOUBLE>, preferred_work_mode STRING,
  willing_to_relocate BOOLEAN, github_activity_score DOUBLE, search_appearance_30d INT,
  saved_by_recruiters_30d INT, interview_completion_rate DOUBLE, offer_acceptance_rate DOUBLE,
  verified_email BOOLEAN, verified_phone BOOLEAN, linkedin_connected BOOLEAN>
"""


def profile_ddl(signals: str = "signals") -> str:
    """The schema with the behavioural signals under the name that the input uses."""
    return PROFILE_DDL.format(signals=signals)


@dataclass(frozen=True)
class JobSpec:
    """What to rank for. It is the query, so it becomes column expressions when the plan is built."""

    family: str
    keywords: tuple[str, ...]
    title_terms: tuple[str, ...]
    req_skills: tuple[str, ...]
    seniority_years: int = 5
    seniority_min: float = 5.0
    seniority_max: float = 9.0
    specialist: tuple[str, ...] = ()
    offdomain_titles: tuple[str, ...] = ()
    relevant_titles: tuple[str, ...] = ()
    narrow_domain: tuple[str, ...] = ()
    counter_domain: tuple[str, ...] = ()
    consulting: tuple[str, ...] = ()
    research_markers: tuple[str, ...] = ()
    production_markers: tuple[str, ...] = ()
    preferred_cities: tuple[str, ...] = ()
    home_places: tuple[str, ...] = ()
    reference_date: str = "2026-05-27"
