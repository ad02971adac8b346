"""Coordinates to maps, from the command line: spark-submit textmap/plans/maps_cli.py COORDINATES MASK OUT."""

from __future__ import annotations

import argparse

from textmap.operators import space
from textmap.sources import coordinates, nifti


def main(argv=None, spark=None) -> None:
    p = argparse.ArgumentParser(description="Smoothed maps of each study's coordinates, as Parquet rows or as one volume per study.")
    p.add_argument("coordinates", help="TSV or CSV with a study column and x, y, z")
    p.add_argument("mask", help="NIfTI-1 volume; its non-zero voxels are the map")
    p.add_argument("out")
    p.add_argument("--fwhm", type=float, default=8.0, help="width of the Gaussian at half maximum, in mm")
    p.add_argument("--target-affine", type=float, nargs=3, default=None, help="voxel sizes of the maps, if not the mask's")
    p.add_argument("--volumes", action="store_true", help="write <study>.nii.gz files, not Parquet")
    args = p.parse_args(argv)
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("maps").getOrCreate()
    mask, grid = nifti.read_mask(spark, args.mask)
    if args.target_affine is not None:
        target = grid.resampled(args.target_affine)
        mask, grid = space.resampled_mask(mask, grid, target), target
    maps = space.coordinates_to_maps(coordinates.read_coordinates(spark, args.coordinates), mask, grid, args.fwhm)
    if args.volumes:
        nifti.write_volumes(maps, grid, args.out)
    else:
        coordinates.write_maps(maps, args.out)


if __name__ == "__main__":
    main()
