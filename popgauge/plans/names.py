"""Display names and groupings used in reports."""

from __future__ import annotations

# Display names of models.
MODEL_NAMES = {
    "llama3_8b_instruct": "LLama3 8B",
    "llama3_8b_instruct_sft": "LLama3 8B SFT",
    "llama3_8b": "LLama3 8B",
    "llama3_70b_instruct": "LLama3 70B",
    "llama3_70b": "LLama3 70B",
    "mistral_7b_instruct": "Mistral 7B",
    "mistral_7b_instruct_sft": "Mistral 7B SFT",
    "mistral_7b": "Mistral 7B",
    "deepseek_7b_chat": "DeepSeek 7B",
    "deepseek_7b": "DeepSeek 7B",
    "phi4": "Phi4",
    "gemma3_27b_instruct": "Gemma3 27B",
    "gemma3_27b": "Gemma3 27B",
    "deepseekR1_32b": "DeepSeek R1 (Qwen 32B)",
    "gpt-4.1": "GPT 4.1",
    "o4-mini": "o4 mini",
}

# Parameter counts in billions.
MODEL_SIZES = {
    "phi4": 1.8, "mistral_7b_instruct": 7.0, "deepseek_7b_chat": 7.0, "llama3_8b_instruct": 8.0,
    "gemma3_27b_instruct": 27.0, "llama3_70b_instruct": 70.0, "gpt-4.1": 1800.0,
}

# Display names of datasets.
DATASET_NAMES = {
    "nhanes": "NHANES", "gss": "GSS", "brfss": "BRFSS", "nsduh": "NSDUH", "acs": "ACS", "edu": "IPEDS",
    "fbi_arrests": "FBI Arrests", "labor": "BLS", "meps": "MEPS", "scf": "SCF",
}

# Domain of each dataset, and the order of domains.
DOMAINS = {
    "BRFSS": "Health", "NHANES": "Health", "NSDUH": "Health", "MEPS": "Health",
    "GSS": "Social", "FBI Arrests": "Social", "IPEDS": "Social",
    "BLS": "Economic", "ACS": "Economic", "SCF": "Economic",
}
DOMAIN_ORDER = ("Health", "Social", "Economic")

# Display names of variables.
VARIABLE_NAMES = {
    "diabetes": "Diabetes", "high_bp": "High Blood Pressure", "depression": "Depression",
    "insured": "Health Insurance", "cig_monthly": "Cigarette Use (Last 30d)", "mj_ever": "Marijuana Use",
    "coc_ever": "Cocaine Use", "house_own": "Home Ownership", "age_group": "Age", "age": "Age",
    "education": "Education", "education_years": "Education", "edu": "Education", "race": "Race",
    "sex": "Sex", "income": "Income",
}

# Variables that make a task sensitive.
SENSITIVE_VARIABLES = ("sex", "race")
