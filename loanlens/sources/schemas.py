"""IO1 - the five raw lending schemas, as Spark DDL.

The column lists below are FIXED VALUES: they are the positional layout of
the public lending CSV files (column names lower-cased, in file order) and
must stay exactly as written for positional CSV loading to work.
"""

from __future__ import annotations

from pyspark.sql import types as T

AMOUNT = T.DecimalType(18, 4)

# ---- FIXED VALUES: raw file layouts (file order) ---------------------------
APPLICATION_TRAIN = """
sk_id_curr bigint, target int, name_contract_type string, code_gender string, flag_own_car string,
flag_own_realty string, cnt_children int, amt_income_total decimal(18,4), amt_credit decimal(18,4),
amt_annuity decimal(18,4), amt_goods_price decimal(18,4), name_type_suite string, name_income_type
string, name_education_type string, name_family_status string, name_housing_type string,
region_population_relative decimal(18,4), days_birth int, days_employed int, days_registration
decimal(18,4), days_id_publish int, own_car_age decimal(18,4), flag_mobil int, flag_emp_phone int,
flag_work_phone int, flag_cont_mobile int, flag_phone int, flag_email int, occupation_type string,
cnt_fam_members decimal(18,4), region_rating_client int, region_rating_client_w_city int,
weekday_appr_process_start string, hour_appr_process_start int, reg_region_not_live_region int,
reg_region_not_work_region int, live_region_not_work_region int, reg_city_not_live_city int,
reg_city_not_work_city int, live_city_not_work_city int, organization_type string, ext_source_1
decimal(18,4), ext_source_2 decimal(18,4), ext_source_3 decimal(18,4), apartments_avg decimal(18,4),
basementarea_avg decimal(18,4), years_beginexpluatation_avg decimal(18,4), years_build_avg
decimal(18,4), commonarea_avg decimal(18,4), elevators_avg decimal(18,4), entrances_avg
decimal(18,4), floorsmax_avg decimal(18,4), floorsmin_avg decimal(18,4), landarea_avg decimal(18,4),
livingapartments_avg decimal(18,4), livingarea_avg decimal(18,4), nonlivingapartments_avg
decimal(18,4), nonlivingarea_avg decimal(18,4), apartments_mode decimal(18,4), basementarea_mode
decimal(18,4), years_beginexpluatation_mode decimal(18,4), years_build_mode decimal(18,4),
commonarea_mode decimal(18,4), elevators_mode decimal(18,4), entrances_mode decimal(18,4),
floorsmax_mode decimal(18,4), floorsmin_mode decimal(18,4), landarea_mode decimal(18,4),
livingapartments_mode decimal(18,4), livingarea_mode decimal(18,4), nonlivingapartments_mode
decimal(18,4), nonlivingarea_mode decimal(18,4), apartments_medi decimal(18,4), basementarea_medi
decimal(18,4), years_beginexpluatation_medi decimal(18,4), years_build_medi decimal(18,4),
commonarea_medi decimal(18,4), elevators_medi decimal(18,4), entrances_medi decimal(18,4),
floorsmax_medi decimal(18,4), floorsmin_medi decimal(18,4), landarea_medi decimal(18,4),
livingapartments_medi decimal(18,4), livingarea_medi decimal(18,4), nonlivingapartments_medi
decimal(18,4), nonlivingarea_medi decimal(18,4), fondkapremont_mode string, housetype_mode string,
totalarea_mode decimal(18,4), wallsmaterial_mode string, emergencystate_mode string,
obs_30_cnt_social_circle decimal(18,4), def_30_cnt_social_circle decimal(18,4),
obs_60_cnt_social_circle decimal(18,4), def_60_cnt_social_circle decimal(18,4),
days_last_phone_change decimal(18,4), flag_document_2 int, flag_document_3 int, flag_document_4 int,
flag_document_5 int, flag_document_6 int, flag_document_7 int, flag_document_8 int, flag_document_9
int, flag_document_10 int, flag_document_11 int, flag_document_12 int, flag_document_13 int,
flag_document_14 int, flag_document_15 int, flag_document_16 int, flag_document_17 int,
flag_document_18 int, flag_document_19 int, flag_document_20 int, flag_document_21 int,
amt_req_credit_bureau_hour decimal(18,4), amt_req_credit_bureau_day decimal(18,4),
amt_req_credit_bureau_week decimal(18,4), amt_req_credit_bureau_mon decimal(18,4),
amt_req_credit_bureau_qrt decimal(18,4), amt_req_credit_bureau_year decimal(18,4)
"""

INSTALLMENTS_PAYMENTS = """
sk_id_prev bigint, sk_id_curr bigint, num_instalment_version decimal(18,4), num_instalment_number
int, days_instalment decimal(18,4), days_entry_payment decimal(18,4), amt_instalment decimal(18,4),
amt_payment decimal(18,4)
"""

CREDIT_CARD_BALANCE = """
sk_id_prev bigint, sk_id_curr bigint, months_balance int, amt_balance decimal(18,4),
amt_credit_limit_actual int, amt_drawings_atm_current decimal(18,4), amt_drawings_current
decimal(18,4), amt_drawings_other_current decimal(18,4), amt_drawings_pos_current decimal(18,4),
amt_inst_min_regularity decimal(18,4), amt_payment_current decimal(18,4), amt_payment_total_current
decimal(18,4), amt_receivable_principal decimal(18,4), amt_recivable decimal(18,4),
amt_total_receivable decimal(18,4), cnt_drawings_atm_current decimal(18,4), cnt_drawings_current
int, cnt_drawings_other_current decimal(18,4), cnt_drawings_pos_current decimal(18,4),
cnt_instalment_mature_cum decimal(18,4), name_contract_status string, sk_dpd int, sk_dpd_def int
"""

POS_CASH_BALANCE = """
sk_id_prev bigint, sk_id_curr bigint, months_balance int, cnt_instalment decimal(18,4),
cnt_instalment_future decimal(18,4), name_contract_status string, sk_dpd int, sk_dpd_def int
"""

BUREAU = """
sk_id_curr bigint, sk_id_bureau bigint, credit_active string, credit_currency string, days_credit
int, credit_day_overdue int, days_credit_enddate decimal(18,4), days_enddate_fact decimal(18,4),
amt_credit_max_overdue decimal(18,4), cnt_credit_prolong int, amt_credit_sum decimal(18,4),
amt_credit_sum_debt decimal(18,4), amt_credit_sum_limit decimal(18,4), amt_credit_sum_overdue
decimal(18,4), credit_type string, days_credit_update int, amt_annuity decimal(18,4)
"""

# layouts by raw table, as DDL text (``T.StructType.fromDDL`` parses it)
RAW_SCHEMAS = {
    "raw_application_train": APPLICATION_TRAIN,
    "raw_installments_payments": INSTALLMENTS_PAYMENTS,
    "raw_credit_card_balance": CREDIT_CARD_BALANCE,
    "raw_pos_cash_balance": POS_CASH_BALANCE,
    "raw_bureau": BUREAU,
}
