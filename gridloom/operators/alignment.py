"""Alignment of a subject with a template: affine search, displacement, warping, over several image kinds at once."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..layout import AXES, Grid
from . import registration as R
from .affine_search import AffineSearch, moment_start
from .affine_search import matrix as affine_matrix
from .affine_search import search as affine_search
from .displacement import Search, search
from .graph import saved
from .histogram import normalize_otsu_median
from .resample import compose_displacement, downsample_with_padding, resample_affine
from .stats import pair_statistics


def subject_preprocess(grid: Grid) -> Grid:
    """Values scaled so that tissue lies around the middle of the range."""
    return normalize_otsu_median(grid)


def match_resolution(subject: Grid, template: Grid) -> tuple[Grid, Grid]:
    """The finer side is halved until the voxel sizes are within a factor of two."""
    while subject.vs[0] * 2 <= template.vs[0] and min(subject.shape[: subject.dim]) > 8:
        subject = downsample_with_padding(subject)
    while template.vs[0] * 2 <= subject.vs[0] and min(template.shape[: template.dim]) > 8:
        template = downsample_with_padding(template)
    return subject, template


@dataclass
class Alignment:
    """subject and template: images of the same kinds in the same order, each list of one shape."""

    subject: list[Grid]
    template: list[Grid]
    matrix: list[float] = field(default_factory=lambda: [1.0, 0, 0, 0, 0, 1.0, 0, 0, 0, 0, 1.0, 0])
    displacement: DataFrame | None = None

    def linear(self, low, high, cost: str = "corr", rounds: int = 2) -> float:
        """Affine search on the first kind within bounds of the twelve parameters; the cost reached."""
        self.matrix, value = R.linear(self.template[0], self.subject[0], low, high, cost, rounds)
        return value

    def linear_by_levels(self, options: AffineSearch | None = None, from_moments: bool = False) -> float:
        """Affine search in voxel sizes, stage by stage over halved images first, of all kinds together; the cost reached."""
        start = moment_start(self.template[0], self.subject[0]) if from_moments else None
        p, value = affine_search(self.template, self.subject, options, start)
        self.matrix = affine_matrix(p, self.template[0], self.subject[0])
        return value

    def to_template(self, points: DataFrame) -> DataFrame:
        """points with x, y, z in the subject's voxels as u, v, w in the template's, by the matrix alone."""
        m = np.linalg.inv(np.vstack([np.array(self.matrix).reshape(3, 4), [0, 0, 0, 1]]))
        return points.withColumns({n: sum((F.col(a) * float(m[r, c]) for c, a in enumerate(AXES)), F.lit(float(m[r, 3]))) for r, n in enumerate("uvw")})

    def to_subject(self, points: DataFrame) -> DataFrame:
        """points with x, y, z in the template's voxels as u, v, w in the subject's, by the matrix, after the displacement
        of their place if there is one (points on whole voxels)."""
        at = points
        if self.displacement is not None:
            moves = self.displacement.select("img", *AXES, "dx", "dy", "dz")
            at = points.join(moves, ["img", *AXES], "left").withColumns({f"p{a}": F.col(a) + F.coalesce(f"d{a}", F.lit(0.0)) for a in AXES})
        else:
            at = points.withColumns({f"p{a}": F.col(a).cast("double") for a in AXES})
        m = np.array(self.matrix).reshape(3, 4)
        moved = at.withColumns({n: sum((F.col(f"p{a}") * float(m[r, c]) for c, a in enumerate(AXES)), F.lit(float(m[r, 3]))) for r, n in enumerate("uvw")})
        return moved.select(*points.columns, "u", "v", "w")

    def mapping(self) -> DataFrame:
        """(img, x, y, z, u, v, w): where each template voxel lies in the subject."""
        return self.to_subject(self.template[0].df.select("img", *AXES))

    def export(self, path: str, k: int = 0, kind: str = "nifti") -> None:
        """The subject's kind k in the template's space, written as image files."""
        from ..plans.commands import save

        t = self.template[k]
        save(replace(self.moved(k), vs=t.vs, affine=t.affine), path, kind)

    def moved(self, k: int = 0, interpolation: str = "linear") -> Grid:
        """The subject's kind k in the template's space, by the matrix and then by the displacement if there is one."""
        g = resample_affine(self.subject[k], self.template[k].shape, self.matrix, interpolation)
        return g if self.displacement is None else compose_displacement(g, self.displacement, interpolation)

    def nonlinear(self, options: Search | None = None) -> None:
        """Displacement after the affine step, from all kinds together."""
        moving = [resample_affine(s, t.shape, self.matrix) for s, t in zip(self.subject, self.template, strict=True)]
        moving = [g.with_df(saved(g.df, "affine")) for g in moving]
        self.displacement = search(self.template, moving, options)

    def correlations(self) -> list[float]:
        """Of each kind, over voxels where the template isn't 0."""
        out = []
        for k, t in enumerate(self.template):
            pair = R.pair_of(t, self.moved(k)).where("a <> 0")
            out.append(pair_statistics(pair).first()["correlation"])
        return out

    def match_field_of_view(self) -> list[Grid]:
        """Templates with 0 where the subject has no voxel."""
        ones = replace(self.subject[0], df=self.subject[0].df.withColumn("v", F.lit(1.0)))
        seen = resample_affine(ones, self.template[0].shape, self.matrix).df.select("img", "idx", F.col("v").alias("seen"))
        return [t.with_df(t.df.join(seen, ["img", "idx"]).withColumn("v", F.when(F.col("seen") > 0, F.col("v")).otherwise(F.lit(0))).select(t.df.columns)) for t in self.template]
