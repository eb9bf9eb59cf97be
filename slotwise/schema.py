"""Column names of the operating-room log."""

from __future__ import annotations

# Source header -> column name, completed operations.
COMPLETED_COLUMNS = {
    "Case-ID Anonymous": "case_id",
    "Patient Alder": "patient_age",
    "Speciale": "specialty",
    "Stue": "or_room",
    "Operationsgang ID": "or_hallway_id",
    "Akut case (J/N)": "is_acute",
    "Dato": "date",
    "Pt ankommet til hospitalet": "ts_patient_arrived",
    "Planlagt stue klargøring start": "ts_or_prep_planned_start",
    "Stue klargøring start": "ts_or_prep_start",
    "Stue klargjort": "ts_or_prep_done",
    "Patient på stuen (Planlagt)": "ts_patient_in_or_planned",
    "Patient på stuen": "ts_patient_in_or",
    "Anæstesistart": "ts_anesthesia_start",
    "Anæstesi melder klar": "ts_anesthesia_ready",
    "Procedure start": "ts_procedure_start",
    "Procedure slut": "ts_procedure_end",
    "Patient klar til afgang": "ts_patient_ready_to_leave",
    "Patient forlader stuen (Planlagt)": "ts_patient_leaves_or_planned",
    "Patient forlader stuen": "ts_patient_leaves_or",
    "Stue rengjort (Planlagt)": "ts_or_cleaned_planned",
    "Stue rengøring start": "ts_or_cleaning_start",
    "Stue rengjort": "ts_or_cleaned",
    "I opvågning": "ts_recovery_start",
    "Anæstesistop": "ts_anesthesia_end",
    "Klar til udskrivelse efter opvågning": "ts_ready_for_discharge",
    "Patient forlader afdeling": "ts_patient_discharged",
    "Forsinkelse (minutter)": "delay_minutes",
    "Overskredet (minutter)": "overtime_minutes",
    "Forsinkelsesårsag": "delay_reason",
    "Procedure - Tekst & ID": "procedure_text_id",
    "Aktionsdiagnose - Kode & tekst": "diagnosis_code_text",
    "Aktionsdiagnose - Gruppe": "diagnosis_group",
}

# Source header -> column name, cancelled operations. One header
# ends with a space in the source.
CANCELLED_COLUMNS = {
    "Case-ID Anonymous": "case_id",
    "Dato og tid": "scheduled_datetime",
    "Primær procedure - Tekst": "primary_procedure",
    "Aflyst efter operationsprogrammet er afsluttet?": "cancelled_after_program_planned",
    "Aflyst på dagen for operationen? ": "cancelled_on_day_of_surgery",
    "Aflysningsårsag": "cancellation_reason",
    "Forventet varighed (min.)": "expected_duration_min",
    "Ombooket": "is_rebooked",
    "Stue": "or_room",
    "Operationsgang ID": "or_hallway_id",
}

# Header prefix of a 0/1 column -> prefix of its column name.
FLAG_PREFIXES = {"Staff.": "staff_", "Ressource.": "resource_"}

# Fixed value: the text that means yes.
YES = "Ja"

# Specialties outside the surgical analysis set.
NON_SURGICAL = (
    "Onkologi",
    "Pædiatri",
    "Neurologi",
    "Kardiologi",
    "Hæmatologi",
    "Lungesygdomme",
    "Medicinsk gastroenterologi",
    "Nefrologi",
    "Anæstesiologi",
)

# English names of the specialties for display.
SPECIALTY_NAMES = {
    "Alloplastik": "Arthroplasty",
    "Anæstesiologi": "Anesthesiology",
    "Brystkirurgi": "Breast surgery",
    "Børnekirurgi": "Pediatric surgery",
    "Børneortopædi": "Pediatric orthopedics",
    "Gynækologi": "Gynecology",
    "Gynækologi-obstetrik": "Gynecology-obstetrics",
    "Hjertekirurgi": "Cardiac surgery",
    "Håndkirurgi": "Hand surgery",
    "Hæmatologi": "Hematology",
    "Hæmatologi-Onkologi pædiatrisk": "Pediatric hemato-oncology",
    "Kardiologi": "Cardiology",
    "Karkirurgi": "Vascular surgery",
    "Kirurgi": "General surgery",
    "Lungesygdomme": "Pulmonology",
    "Medicinsk gastroenterologi": "Gastroenterology",
    "Nefrologi": "Nephrology",
    "Neurokirurgi": "Neurosurgery",
    "Neurologi": "Neurology",
    "Obstetrik": "Obstetrics",
    "Onkologi": "Oncology",
    "Ortopædkirurgi": "Orthopedic surgery",
    "Plastikkirurgi": "Plastic surgery",
    "Pædiatri": "Pediatrics",
    "Rygkirurgi": "Spine surgery",
    "Tand- mund- og kæbekirurgi": "Oral & maxillofacial",
    "Thoraxkirurgi": "Thoracic surgery",
    "Traumeortopædi": "Trauma orthopedics",
    "Tumorortopædi": "Tumor orthopedics",
    "Urologi": "Urology",
    "Øjenkirurgi": "Ophthalmology",
    "Øre-næse-hals": "ENT",
}
