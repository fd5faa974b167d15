"""Canonical schemas and the fixed dimensions shared by all operators."""

from __future__ import annotations

RUN_FILES = "root string, run_path string, rel_path string, file_name string, is_dir boolean, length bigint, error string"
LOG_LINES = "run_path string, file_name string, line_no bigint, line string"
CONFIG_DOCS = "config_dir string, kind string, file_name string, raw string"
CONFIG_FIELDS = "config_dir string, kind string, pos int, field string, value string"
QUEUE = "job_name string, workdir string, job_id string"
ISSUES = "run_path string, category string, severity int, file_name string, line_no bigint, message string"

# Completion status names and their severity.
SEVERITY = {
    "completed": 0,
    "running": 1,
    "error": 2,
    "failed": 3,
    "not_started": 4,
    "not_configured": 5,
}

# Files that make a directory a run of a model, in detection order of the models.
MODEL_MARKERS = {
    "ADCIRC": ["fort.14", "fort.15"],
    "SCHISM": ["hgrid.gr3", "vgrid.in", "param.nml", "outputs", "bctides.in"],
}

# Fixed value: an output file counts as started only above this many bytes.
MINIMUM_OUTPUT_BYTES = 43081

# Files a fully written run directory holds, per model, and the extra ones.
WRITTEN_FILES = {
    "ADCIRC": ["fort.13", "fort.14", "fort.15", "setup.job", "adcirc.job"],
    "SCHISM": [
        "bctides.in",
        "hgrid.gr3",
        "hgrid.ll",
        "manning.gr3",
        "outputs",
        "param.nml",
        "vgrid.in",
        "schism.job",
    ],
}
WRITTEN_FILES_COUPLED = ["nems.configure", "atm_namelist.rc", "model_configure", "config.rc"]
WRITTEN_FILE_ASWIP = "fort.22"

# Platform name -> processors per node, launcher, Slurm use, account, partition.
PLATFORMS = [
    ("HERA", 40, "srun", True, "coastal", None),
    ("ORION", 40, "srun", True, "nosofs", "orion"),
    ("STAMPEDE2", 68, "ibrun", True, "coastal", "development"),
    ("LOCAL", 1, None, False, None, None),
    ("SLURM", 36, "srun", True, None, None),
]
PLATFORM_SCHEMA = (
    "platform string, processors_per_node int, launcher string, uses_slurm boolean, "
    "default_account string, default_partition string"
)

# E-mail notification options and tidal sources, by name.
EMAIL_TYPES = [
    "NONE", "BEGIN", "END", "FAIL", "REQUEUE", "STAGE_OUT", "ALL",
    "TIME_LIMIT", "TIME_LIMIT_90", "TIME_LIMIT_80", "TIME_LIMIT_50", "ARRAY_TASKS",
]
TIDAL_SOURCES = ["TPXO", "HAMTIDE"]

# The declared fields of each document kind. Types: string, int, float, bool,
# datetime, duration (seconds), path, fixed_path (never made relative), enum, list, pairs, map.
_CAP = {"processors": "int", "nems_parameters": "map"}
_MODEL_COMMON = {
    "modeled_start_time": "datetime",
    "modeled_end_time": "datetime",
    "modeled_timestep": "duration",
    "tidal_spinup_duration": "duration",
    "tidal_spinup_timestep": "duration",
    "source_filename": "path",
    "use_original_mesh": "bool",
    "output_surface": "bool",
    "surface_output_interval": "duration",
    "output_stations": "bool",
    "stations_file_path": "path",
    "stations_output_interval": "duration",
    "output_spinup": "bool",
    "output_elevations": "bool",
}
KIND_FIELDS = {
    "modeldriver": {"platform": "enum", "perturbations": "map"},
    "slurm": {
        "account": "string",
        "partition": "string",
        "job_duration": "duration",
        "run_directory": "path",
        "run_name": "string",
        "email_type": "enum",
        "email_address": "string",
        "log_filename": "path",
        "modules": "list",
        "path_prefix": "path",
        "extra_commands": "list",
        "launcher": "string",
        "nodes": "int",
    },
    "nems": {
        "executable_path": "path",
        "modeled_start_time": "datetime",
        "modeled_end_time": "datetime",
        "interval": "duration",
        "connections": "pairs",
        "mediations": "list",
        "sequence": "list",
    },
    "adcirc": {
        "adcirc_executable_path": "path",
        "adcprep_executable_path": "path",
        "aswip_executable_path": "path",
        "fort_13_path": "path",
        "fort_14_path": "path",
        **_MODEL_COMMON,
        "output_velocities": "bool",
        "output_concentrations": "bool",
        "output_meteorological_factors": "bool",
        **_CAP,
        "attributes": "map",
    },
    "schism": {
        "schism_executable_path": "path",
        "schism_hotstart_combiner_path": "path",
        "schism_schout_combiner_path": "path",
        "fgrid_path": "path",
        "hgrid_path": "path",
        "schism_use_old_io": "bool",
        **_MODEL_COMMON,
        **_CAP,
        "attributes": "map",
    },
    "tidal": {"tidal_source": "enum", "constituents": "list", "resource": "fixed_path"},
    "besttrack": {
        "nhc_code": "string",
        "interval": "duration",
        "start_date": "datetime",
        "end_date": "datetime",
        "fort22_filename": "fixed_path",
        "nws": "int",
        "attributes": "map",
    },
    "owi": {"nws": "int", "interval": "duration"},
    "atmesh": {"nws": "int", "resource": "path", "interval": "duration", **_CAP},
    "ww3data": {"nrs": "int", "resource": "path", "interval": "duration", **_CAP},
    "nwm": {
        "aggregation_radius": "float",
        "cache": "bool",
        "source_json": "path",
        "sink_json": "path",
        "pairing_hgrid": "path",
        "resource": "fixed_path",
    },
    "sflux": {"nws": "int", "resource": "path", "sflux_1_glob": "string", "sflux_2_glob": "string"},
}

# File names whose stem differs from the kind.
KIND_FILE_STEMS = {"sfluxfiles": "sflux"}

# Which kinds a configuration of a model must and may hold.
REQUIRED_KINDS = {
    "ADCIRC": ["modeldriver", "slurm", "adcirc"],
    "NEMS_ADCIRC": ["modeldriver", "nems", "slurm", "adcirc"],
    "SCHISM": ["modeldriver", "slurm", "schism"],
}
SUPPLEMENTARY_KINDS = {
    "ADCIRC": ["tidal", "besttrack", "owi", "atmesh", "ww3data"],
    "NEMS_ADCIRC": ["tidal", "besttrack", "owi", "atmesh", "ww3data"],
    "SCHISM": ["tidal", "besttrack", "nwm", "sflux"],
}

# Forcing names a user may ask for, per model.
FORCING_NAMES = {
    "ADCIRC": ["tidal", "atmesh", "besttrack", "owi", "ww3data"],
    "SCHISM": ["tidal", "besttrack", "nwm", "sfluxfiles"],
}

# Forcing kinds a model cannot take.
UNSUPPORTED_FORCINGS = {
    "ADCIRC": ["nwm", "sflux"],
    "SCHISM": ["owi", "atmesh", "ww3data"],
}

# Defaults applied to null fields, per kind, as JSON literals.
KIND_DEFAULTS = {
    "modeldriver": {"perturbations": '{"unperturbed":null}'},
    "adcirc": {
        "surface_output_interval": "3600.0",
        "stations_output_interval": "360.0",
        "processors": "11",
        "nems_parameters": "{}",
    },
    "schism": {
        "surface_output_interval": "3600.0",
        "stations_output_interval": "360.0",
        "processors": "11",
        "nems_parameters": "{}",
    },
    "tidal": {"constituents": '["All"]'},
    "besttrack": {"nws": "20"},
    "owi": {"nws": "12", "interval": "3600.0"},
    "atmesh": {"nws": "17", "interval": "3600.0", "processors": "1", "nems_parameters": "{}"},
    "ww3data": {"nrs": "5", "interval": "3600.0", "processors": "1", "nems_parameters": "{}"},
    "sflux": {"nws": "2", "sflux_1_glob": '"*_1.*"', "sflux_2_glob": '"*_2.*"'},
}

# Defaults for fields that are absent from a document (an explicit null stays null).
ABSENT_DEFAULTS = {
    "adcirc": {
        "use_original_mesh": "false",
        "output_surface": "true",
        "output_stations": "false",
        "output_spinup": "true",
        "output_elevations": "true",
        "output_velocities": "true",
        "output_concentrations": "false",
        "output_meteorological_factors": "false",
    },
    "schism": {
        "schism_use_old_io": "false",
        "use_original_mesh": "false",
        "output_surface": "true",
        "output_stations": "false",
        "output_spinup": "true",
        "output_elevations": "true",
        "output_velocities": "true",
    },
}

# Wind parameters that need the asymmetric-wind preprocessor.
ASWIP_NWS = [8, 19, 20, 21]

# Defaults of a job when nothing else is given, in seconds.
DEFAULT_JOB_SECONDS = 3600
