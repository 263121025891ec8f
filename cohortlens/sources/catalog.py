"""The declared source tables: column names with their widths, by position."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# Fixed value: the patient id column of every table.
ID = "STUDY_PAT_ID"


@dataclass(frozen=True)
class TableSpec:
    name: str
    columns: tuple[str, ...]
    widths: tuple[int, ...]
    text: tuple[str, ...] = ()
    sort: str | None = None
    encoding: str = "UTF-8"
    delimiter: str = "|"
    quote: str = '"'
    id: str = ID
    expected_rows: int = 30_000_000

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c, T.StringType()) for c in self.columns])

    @property
    def pattern(self) -> str:
        """The files of the table inside a source folder."""
        return f"*{self.name}*.csv"

    def require_text(self) -> None:
        if not self.text or self.sort is None:
            raise ValueError(f"{self.name} declares no text and sort columns")


def spec(name: str, columns: str, text: str = "", sort: str | None = None, **other) -> TableSpec:
    pairs = [item.split() for item in columns.replace("\n", " ").split(",")]
    return TableSpec(name, tuple(c for c, _ in pairs), tuple(int(w) for _, w in pairs),
                     tuple(t.strip() for t in text.split(",") if t.strip()), sort, **other)


# The layout of the twelve source tables, as "column width" in file order.
CLINICAL_NOTES = spec("Clinical_Notes", """
STUDY_PAT_ID 32, STUDY_ENC_ID 32, STUDY_NOTE_ID 32, NOTE_AUTHOR_NAME 80, NOTE_COSIGNER_NAME 80,
NOTE_TYPE_NAME 100, NOTE_DT 22, NOTE_CREATE_DT 22, NOTE_FILE_DT 22, LINKED_STUDY_ORDER_ID 10,
NOTE_AUTHOR_SPECIALTY 80, NOTE_COSIGNER_SPECIALTY 80, RPT_TEXT 360000""",
    text="RPT_TEXT",
    sort="NOTE_DT")

DIAGNOSES = spec("Diagnoses", """
STUDY_PAT_ID 32, STUDY_ENC_ID 32, ENCOUNTER_DATE 22, DX_NAME 260, ICD9_CODE 16, ICD9_NAME 260, ICD10_CODE 16,
ICD10_NAME 260, DIAGNOSIS_START_DATE 22, DIAGNOSIS_END_DATE 22, PROBLEM_LIST_FLAG 1, PROBLEM_LIST_STATUS 2,
PRIMARY_DX_FLAG 1, BILLING_DX_FLAG 1, ENCOUNTER_DX_FLAG 1, MEDICAL_HISTORY_DX_FLAG 1,
ORDERED_PROCEDURE_DX_FLAG 1, ORDERED_MEDICATION_DX_FLAG 1, HOSPITAL_ADMISSION_DX_FLAG 1, REFERRAL_DX_FLAG 1,
FOLLOWUP_DX_FLAG 1, CHRONIC_DX_FLAG 1, PRINCIPLE_PROBLEM_DX_FLAG 1""",
    text="DX_NAME, ICD10_NAME, ICD9_NAME",
    sort="DIAGNOSIS_START_DATE")

HOSPITAL_ENCOUNTERS = spec("Hospital_Encounters", """
STUDY_PAT_ID 32, STUDY_ENC_ID 32, HOSPITAL_ADMIT_TIME 22, HOSPITAL_DISCHARGE_TIME 22, INPATIENT_ADMIT_TIME 22,
INPATIENT_LENGTH_OF_STAY 6, FISCAL_LENGTH_OF_STAY 4, FISCAL_ICU_DAYS 3, OPERATIONAL_ICU_DAYS 5,
OPERATIONAL_LENGTH_STAY_DAYS 6, ADMITTING_DX_ICD_CODE 50, ADMITTING_DX_NAME 260, BILL_DX1_ICD10_CODE 50,
BILL_DX1_ICD10_NAME 260, BILL_DX1_ICD9_CODE 50, BILL_DX1_ICD9_NAME 260, BILL_DX2_ICD10_CODE 50,
BILL_DX2_ICD10_NAME 260, BILL_DX2_ICD9_CODE 50, BILL_DX2_ICD9_NAME 260, BILL_DX3_ICD10_CODE 50,
BILL_DX3_ICD10_NAME 260, BILL_DX3_ICD9_CODE 50, BILL_DX3_ICD9_NAME 260, BILL_DX4_ICD10_CODE 50,
BILL_DX4_ICD10_NAME 260, BILL_DX4_ICD9_CODE 50, BILL_DX4_ICD9_NAME 260, ENCOUNTER_ICD10_DIAGNOSES 5000,
ENCOUNTER_ICD9_DIAGNOSES 5000, ENCOUNTER_PROCEDURES 5000, ADMITTED_FROM_ED_YN 1, CHIEF_COMPLAINT 100,
ADMISSION_SOURCE 100, DISCHARGE_LOCATION 30, DISCHARGE_DISPOSITION 100, AIRWAY_DEVICE 1, READMISSION 1,
READMISSION_WITHIN_72_HOURS 1, SUBSEQUENT_ADMIT_WITHIN_30DAYS 1, DAYS_UNTIL_READMISSION 6,
PRIOR_FISCAL_LENGTH_OF_STAY 4, ENCOUNTER_VISIT_TYPE 26, MORTALITY_YN 1, PALLIATIVE_CARE_ORDER_YN 1,
PATIENT_TYPE 20, PAT_STATUS 100, TRANSFER_YN 1, TRANSFER_FROM 50""")

ADMINISTERED_MEDICATIONS = spec("Administered_Medications", """
STUDY_PAT_ID 32, STUDY_ENC_ID 32, RX_DESCRIPTION 200, RX_DISPLAY_NAME 300, RX_ORDER_TO_START_TIME 22,
RX_ORDER_TO_END_TIME 22, RX_ORDER_PLACED 10, RX_ORDER_STARTED 10, ROUTE 20, DOSE 11, FREQUENCY 34,
RX_TAKEN_TIME 22, MAR_RESULT 18""")

AMBULATORY_ENCOUNTERS = spec("Ambulatory_Encounters", """
STUDY_PAT_ID 32, STUDY_ENC_ID 32, AGE_YRS 6, ENC_DATE 22, ENC_TYPE 36, DEPT_NAME 40, DEPT_ID 11,
INSURANCE_PAYOR 50, INSURANCE_CLASS 40, INSURANCE_GROUP 8, ENC_PROVIDER 32, ENC_PROVIDER_SPECIALTY1 60""")

CURRENT_MEDICATIONS = spec("Current_Medications", """
STUDY_PAT_ID 32, STUDY_ENC_ID 32, LAST_CURRENT_MEDS_DATE 10, MED_NAME 100, GENERIC_NAME_1 50,
GENERIC_NAME_2 100, PHARM_CLASS_NAME 50, PHARM_SUBCLASS_NAME 70, THERAPY_CLASS_NAME 50,
ADMINISTRATION_ROUTE 20""",
    text="GENERIC_NAME_1, GENERIC_NAME_2, PHARM_CLASS_NAME, PHARM_SUBCLASS_NAME",
    sort="LAST_CURRENT_MEDS_DATE")

ORDERED_MEDICATIONS = spec("Ordered_Medications", """
STUDY_PAT_ID 32, STUDY_ENC_ID 32, ENCOUNTER_DATE 10, RX_ORDER_PLACED_TIME 10, RX_ORDER_START_TIME 10,
RX_ORDER_END_TIME 10, RX_ORDER_TO_START_TIME 22, RX_ORDER_TO_END_TIME 22, RX_ORDER_DISCONTINUE_TIME 22,
RX_ORDER_MODE 10, MED_NAME 150, GENERIC_NAME_1 50, GENERIC_NAME_2 100, PHARM_CLASS_NAME 50,
PHARM_SUBCLASS_NAME 100, THERAPY_CLASS_NAME 50, ADMINISTRATION_ROUTE 21, DOSE 20, FREQUENCY 34, UNIT 17,
MED_ORDER_STATUS 12""",
    text="GENERIC_NAME_1, GENERIC_NAME_2, PHARM_CLASS_NAME, PHARM_SUBCLASS_NAME, THERAPY_CLASS_NAME",
    sort="ENCOUNTER_DATE")

DEMOGRAPHICS = spec("Demographics", """
STUDY_PAT_ID 32, MRN_CD 8, CURR_AGE_YRS 3, BIRTH_DT 10, GENDER_NM 7, NIH_ETHNCTY 22, NIH_RACE 23,
PT_VIABLE_FLG 1, DEATH_DT 10, LAST_NM 25, FIRST_NM 20, CURR_PCP 60, BIO_SAMPL_OPT_OUT_FLG 1,
GENETC_OPT_OUT_FLG 1""",
    expected_rows=100_000)

ORDER_NARRATIVE = spec("Order_Narrative", """
STUDY_PAT_ID 32, STUDY_ENC_ID 32, STUDY_ORDER_ID 32, ORDER_DATE 16, RESULT_DATE 16, PROC_NAME 100,
NARRATIVE_TEXT 500000""",
    text="NARRATIVE_TEXT",
    sort="ORDER_DATE",
    encoding="ISO-8859-1")

LAB_RESULTS = spec("Lab_Results", """
STUDY_PAT_ID 32, STUDY_ENC_ID 32, STUDY_ORDER_ID 32, SPECIMEN_TAKEN_TIME 22, PROCEDURE_NAME 100,
COMPONENT_NAME 100, RESULT_NUMBER 12, RESULT_EQ_FLAG 3, RESULT_TEXT 1000, ORDER_TIME 22, RESULT_TIME 22,
REFERENCE_UNIT 30, REFERENCE_MINIMUM 20, REFERENCE_MAXIMUM 20""",
    text="PROCEDURE_NAME, COMPONENT_NAME, RESULT_TEXT",
    sort="ORDER_TIME")

RESULT_NOTES = spec("Result_Notes", """
STUDY_PAT_ID 32, STUDY_ENC_ID 32, STUDY_ORDER_ID 32, SPECIMEN_DATE 16, PROC_NAME 100, COMMENT_TEXT 100000""",
    text="COMMENT_TEXT, PROC_NAME",
    sort="SPECIMEN_DATE")

PATHOLOGY = spec("Pathology", """
STUDY_PAT_ID 32, STUDY_ENC_ID 32, STUDY_CASE_ID 32, STUDY_RESULT_ID 32, STUDY_ORDER_ID 32, SOURCE_SYSTEM 8,
SPECIMEN_COLL_DT 10, RESULT_STATUS 8, LAB_STATUS 21, RESULT_COMPLETED_DT 10, REPORT_HEADER 30, REPORT_GROUP 2,
REPORT_LINE 2, REPORT_BODY_LINE_OF_TEXT 300""",
    text="REPORT_BODY_LINE_OF_TEXT",
    sort="RESULT_COMPLETED_DT")

TABLES = {t.name: t for t in (
    CLINICAL_NOTES, DIAGNOSES, HOSPITAL_ENCOUNTERS, ADMINISTERED_MEDICATIONS,
    AMBULATORY_ENCOUNTERS, CURRENT_MEDICATIONS, ORDERED_MEDICATIONS, DEMOGRAPHICS,
    ORDER_NARRATIVE, LAB_RESULTS, RESULT_NOTES, PATHOLOGY,
)}

# The tables of a default run.
DEFAULT_TABLES = (DIAGNOSES, CLINICAL_NOTES, LAB_RESULTS, RESULT_NOTES)
