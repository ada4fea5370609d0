"""Readers and writers of the selection input formats (CSV, TSV, LibSVM, tagged cells, class vector)."""

from .text import (read_instances_text, read_features_text, read_class_vector, read_class_positions, read_classes,
                   read_cells_text, read_libsvm, read_features_libsvm, read_libsvm_ids)
from .lines import read_class_line, read_feature_lines, write_class_line, write_feature_lines
from .sinks import write_instances_text, write_libsvm, write_class_vector, write_cells_text, write_features_text, write_features_libsvm

__all__ = ["read_instances_text", "read_features_text", "read_class_vector", "read_class_positions", "read_classes", "read_cells_text",
           "read_libsvm", "read_features_libsvm", "read_libsvm_ids", "write_instances_text", "write_libsvm",
           "write_class_vector", "write_cells_text", "write_features_text", "write_features_libsvm",
           "read_class_line", "read_feature_lines", "write_class_line", "write_feature_lines"]
