"""strataforge: profiling, key discovery and vault design on Spark DataFrames."""

from strataforge.config import AnalysisConfig, DbtConfig, PipelineConfig, ProfilingConfig, VaultConfig
from strataforge.plans.pipeline import ForgePipeline
from strataforge.plans.report import Report
from strataforge.progress import ProgressEvent, default_progress_callback

__version__ = "0.1.0"
__all__ = ["AnalysisConfig", "DbtConfig", "ForgePipeline", "PipelineConfig", "ProfilingConfig", "ProgressEvent", "Report", "VaultConfig", "default_progress_callback"]
