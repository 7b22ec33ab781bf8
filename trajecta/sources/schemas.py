"""Schemas of the raw clinical tables (read as CSV) and of derived tables; finding columns by parts of their names."""

from __future__ import annotations

from collections.abc import Sequence


def _pairs(names: Sequence[str]) -> str:
    return ", ".join(f"{n}_{s}_VALUE DOUBLE" for n in names for s in ("LOW", "HIGH"))


ID = "STUDY_PATIENT_ID BIGINT"
#: First cohort.
COHORT_A = {
    "SCR_ALL_VALUES": f"{ID}, SCR_ENTERED STRING, SCR_VALUE DOUBLE, SCR_ENCOUNTER_TYPE STRING",
    "ADMISSION_INDX": f"{ID}, HOSP_ADMIT_DATE STRING, HOSP_DISCHARGE_DATE STRING, ICU_ADMIT_DATE STRING, ICU_DISCHARGE_DATE STRING, DISCHARGE_DISPOSITION STRING",
    "RENAL_REPLACE_THERAPY": f"{ID}, HD_START_DATE STRING, HD_STOP_DATE STRING, CRRT_START_DATE STRING, CRRT_STOP_DATE STRING, PD_START_DATE STRING, PD_STOP_DATE STRING, HD_TREATMENTS INT",
    "DEMOGRAPHICS_INDX": f"{ID}, GENDER STRING, RACE STRING",
    "DOB": f"{ID}, DOB STRING",
    "OUTCOMES_COMBINED": f"{ID}, DECEASED_DATE STRING",
    "DIAGNOSIS": f"{ID}, DIAGNOSIS_DESC STRING, ICD_TYPECODE STRING, ICD_CODE STRING",
    "SURGERY_INDX": f"{ID}, SURGERY_DESCRIPTION STRING, SURGERY_PERFORMED_DATE STRING",
    "ESRD_STATUS": f"{ID}, BEFORE_INDEXED_INDICATOR STRING, AT_ADMISSION_INDICATOR STRING, DURING_INDEXED_INDICATOR STRING",
    "USRDS_ESRD": f"{ID}, ESRD_DATE STRING",
    "ESRD_MANUAL_REVISION": f"{ID}, before INT, during INT, rrt_dependent INT",
    "CLINICAL_VITALS": f"{ID}, {_pairs(['ART_MEAN_D1', 'CUFF_MEAN_D1', 'TEMPERATURE_D1', 'HEART_RATE_D1'])}",
    "CLINICAL_OTHERS": f"{ID}, HEIGHT_CM_VALUE DOUBLE, INITIAL_WEIGHT_KG DOUBLE, {_pairs(['FI02_D1', 'RESP_RATE_D1'])}, GLASGOW_SCORE_D1_LOW_VALUE STRING",
    "BLOOD_GAS": f"{ID}, {_pairs(['PH_D1', 'PO2_D1', 'PCO2_D1'])}",
    "MEDICATIONS_INDX": f"{ID}, ORDER_ENTERED_DATE STRING, MEDICATION_NAME STRING, MEDICATION_TYPE STRING, DAYS_ON_MEDICATION DOUBLE",
    "SMOKING_HIS": f"{ID}, SMOKING_HISTORY_STATUS STRING, SMOKING_CURRENT_STATUS STRING",
}
#: Second cohort.
PATIENT = "PATIENT_NUM BIGINT"
COHORT_B = {
    "all_scr_data": f"{PATIENT}, SPECIMN_TEN_TIME STRING, ORD_VALUE DOUBLE, IP_FLAG STRING",
    "tIndexedIcuAdmission": f"{PATIENT}, HSP_ADMSN_TIME STRING, HSP_DISCH_TIME STRING, ICU_ADMSN_TIME STRING, ICU_DISCH_TIME STRING, ESRD_BEFORE_INDEXED_ADT STRING",
    "tDialysis": f"{PATIENT}, START_DATE STRING, END_DATE STRING, DIALYSIS_TYPE STRING",
    "icu_lab_data": f"{PATIENT}, DAY_NO STRING, TERM_GRP_NAME STRING, D_MIN_VAL DOUBLE, D_MAX_VAL DOUBLE",
    "icu_flw_data": f"{PATIENT}, DAY_NO STRING, TERM_GRP_NAME STRING, D_MIN_VAL DOUBLE, D_MAX_VAL DOUBLE, D_SUM_VAL DOUBLE",
    "tPatients": f"{PATIENT}, SEX_ID INT, RACE_WHITE INT, RACE_BLACK INT, DOB STRING, DOD_Epic STRING, DOD_NDRI STRING, DMF_DEATH_DATE STRING",
    "tMedications": f"{PATIENT}, ACEI INT, ARB INT, NSAIDS INT, AMINOGLYCOSIDES INT, PRESSOR_INOTROPE INT",
    "tHospitalFinalDiagnoses": f"{PATIENT}, DX_NAME STRING, CURRENT_ICD9_LIST STRING, CURRENT_ICD10_LIST STRING",
    "tAOS": f"{PATIENT}, {', '.join(f'{k}_{e}_DATE STRING' for k in ('MV', 'IABP', 'VAD', 'ECMO') for e in ('START', 'END'))}",
    "tComorbidity": f"{PATIENT}, DiabetesWithoutChronicComplication INT, DiabetesWithChronicComplication INT, HypertensionUncomplicated INT, HypertensionComplicated INT",
}
#: A public critical-care database: the columns that are read.
COHORT_C = {
    "PATIENTS": "SUBJECT_ID BIGINT, GENDER STRING, DOB STRING, DOD STRING", "ADMISSIONS": "SUBJECT_ID BIGINT, HADM_ID BIGINT, ADMITTIME STRING, DISCHTIME STRING, ETHNICITY STRING",
    "ICUSTAYS": "SUBJECT_ID BIGINT, HADM_ID BIGINT, ICUSTAY_ID BIGINT, INTIME STRING, OUTTIME STRING", "D_LABITEMS": "ITEMID BIGINT, LABEL STRING", "D_ITEMS": "ITEMID BIGINT, LABEL STRING",
    "LABEVENTS": "SUBJECT_ID BIGINT, HADM_ID BIGINT, ITEMID BIGINT, CHARTTIME STRING, VALUENUM DOUBLE", "CHARTEVENTS": "SUBJECT_ID BIGINT, HADM_ID BIGINT, ICUSTAY_ID BIGINT, ITEMID BIGINT, CHARTTIME STRING, VALUENUM DOUBLE", "DATETIMEEVENTS": "SUBJECT_ID BIGINT, HADM_ID BIGINT, ICUSTAY_ID BIGINT, ITEMID BIGINT, VALUE STRING",
}
WINDOWS = "id BIGINT, admit TIMESTAMP, disch TIMESTAMP"
SEQUENCE = "id BIGINT, values ARRAY<DOUBLE>"
EDGES = "id1 BIGINT, id2 BIGINT, d DOUBLE"
ALIGNMENTS = "id1 BIGINT, id2 BIGINT, path1 ARRAY<DOUBLE>, path2 ARRAY<DOUBLE>"


def resolved(names: Sequence[str], *parts: str | Sequence[str]) -> str:
    """The one column whose lower-case name has all parts (of a list of parts, any); an error for none or several."""
    found = [n for n in names if all(any(q in n.lower() for q in ([p] if isinstance(p, str) else p)) for p in parts)]
    if len(found) != 1:
        raise ValueError(f"{len(found)} columns have {parts}: {found}")
    return found[0]
