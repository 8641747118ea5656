"""Fixed values of the data model."""

VARIABLES = ("flow", "velocity", "depth")

# Labels and units of the variables, the colour ramp, the notes of the scales.
LABELS = {"flow": "Flow", "velocity": "Velocity", "depth": "Depth"}
UNITS = {"flow": "m³/s", "velocity": "m/s", "depth": "m"}
PALETTE = ("#0077b6", "#00b4d8", "#90e0ef", "#ffba08", "#ff6b35", "#d00000")
NO_DATA_COLOR = "rgba(0, 0, 0, 0)"
SCALE_NOTES = {
    "linear": "linear",
    "log": "log",
    "sqrt": "√",
    "cbrt": "∛",
    "symlog": "symlog",
    "quantile": "quantile",
    "quantile-classes": "quantile classes",
    "jenks": "natural breaks",
}

# The missing-data mark and the threshold below which a value is missing.
FILL = -9999.0
VALID_ABOVE = -9998.0

# Cells that a sample aims at, values that natural breaks are computed on, the step that separates equal stops,
# and the line widths of the least and the largest value.
SAMPLE_CELLS = 50_000
JENKS_VALUES = 1_000
STEP = 1e-6
WIDTHS = (1.5, 7.0)

PALETTE_RGB = tuple(tuple(int(c[i : i + 2], 16) for i in (1, 3, 5)) for c in PALETTE)
