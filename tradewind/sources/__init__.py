"""Sources and sinks: role views over input tables, the monthly sheet reader and file sinks."""

from .rejects import accepted, audit_roles, insist, json_object, observed, rejected, season_label, whole_number
from .roles import Warehouse, jdbc_reader, mixed_case_reader, parquet_reader
from .sheet import (publish_report, read_report, read_sheet, select_positions, sheet_to_json_arrays, sheet_to_json_rows, shred_json_arrays, shred_json_rows,
                    typed_sheet, write_report)
from .state import advance, files_of, read_state
from .store import StoredWarehouse, save_roles

__all__ = ["Warehouse", "jdbc_reader", "mixed_case_reader", "parquet_reader", "StoredWarehouse", "save_roles", "publish_report", "read_report", "read_sheet",
           "select_positions", "sheet_to_json_arrays", "sheet_to_json_rows", "shred_json_arrays", "shred_json_rows", "typed_sheet",
           "write_report", "advance", "files_of", "read_state", "accepted", "audit_roles", "insist", "json_object", "observed", "rejected", "season_label", "whole_number"]
