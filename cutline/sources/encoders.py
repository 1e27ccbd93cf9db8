"""Arguments of encoders, shader chains and detector defaults."""

from __future__ import annotations

#: What each codec is encoded with on the CPU, and on the GPU where that can.
VIDEO_ARGS: dict[str, tuple[tuple[str, ...], tuple[str, ...] | None]] = {
    "h264_main": (("libx264", "-profile:v", "main", "-pix_fmt", "yuv420p", "-preset", "medium", "-crf", "18"), ("h264_nvenc", "-profile:v", "main", "-pix_fmt", "yuv420p", "-cq", "19")),
    "h264_high": (("libx264", "-profile:v", "high", "-pix_fmt", "yuv420p", "-preset", "medium", "-crf", "18"), ("h264_nvenc", "-profile:v", "high", "-pix_fmt", "yuv420p", "-cq", "19")),
    "h264_high10": (("libx264", "-profile:v", "high10", "-pix_fmt", "yuv420p10le", "-preset", "slow", "-crf", "19"), None),
    "h264_high422": (("libx264", "-profile:v", "high422", "-pix_fmt", "yuv422p", "-preset", "slow", "-crf", "18"), None),
    "h265_main": (("libx265", "-profile:v", "main", "-pix_fmt", "yuv420p", "-preset", "medium", "-crf", "20"), ("hevc_nvenc", "-profile:v", "main", "-pix_fmt", "yuv420p", "-cq", "19")),
    "h265_main10": (("libx265", "-profile:v", "main10", "-pix_fmt", "yuv420p10le", "-preset", "slow", "-crf", "21"), ("hevc_nvenc", "-profile:v", "main10", "-pix_fmt", "p010le", "-cq", "20")),
    "h265_main12": (("libx265", "-profile:v", "main12", "-pix_fmt", "yuv420p12le", "-preset", "slow", "-crf", "22"), None),
    "h265_main422_10": (("libx265", "-profile:v", "main422-10", "-pix_fmt", "yuv422p10le", "-preset", "slow", "-crf", "21"), None),
    "av1_main": (("libsvtav1", "-preset", "6", "-crf", "32"), ("av1_nvenc", "-pix_fmt", "yuv420p", "-cq", "28")),
    "prores_422_lt": (("prores_ks", "-profile:v", "1", "-pix_fmt", "yuv422p10le"), None),
    "prores_422": (("prores_ks", "-profile:v", "2", "-pix_fmt", "yuv422p10le"), None),
    "prores_422_hq": (("prores_ks", "-profile:v", "3", "-pix_fmt", "yuv422p10le"), None),
    "prores_4444": (("prores_ks", "-profile:v", "4", "-pix_fmt", "yuva444p10le"), None),
    "prores_4444_xq": (("prores_ks", "-profile:v", "5", "-pix_fmt", "yuva444p10le"), None),
}
DEFAULT_VIDEO = "h264_high"
#: What each audio mode is encoded with.
AUDIO_ARGS: dict[str, tuple[str, ...]] = {
    "copy": ("-c:a", "copy"),
    "pcm16": ("-c:a", "pcm_s16le", "-ar", "48000"),
    "pcm24": ("-c:a", "pcm_s24le", "-ar", "48000"),
    "flac": ("-c:a", "flac", "-compression_level", "5"),
    "alac": ("-c:a", "alac"),
    "opus": ("-c:a", "libopus", "-b:a", "160k", "-vbr", "on", "-application", "audio"),
    "mp3": ("-c:a", "libmp3lame", "-b:a", "320k"),
    "none": ("-an",),
    "aac_320": ("-c:a", "aac", "-b:a", "320k", "-ar", "48000"),
    "aac": ("-c:a", "aac", "-b:a", "192k", "-ar", "48000"),
}
DEFAULT_AUDIO = "aac"
#: Files of each shader mode that restore, and the one that doubles the size.
SHADERS: dict[str, tuple[tuple[str, ...], str]] = {
    "light": ((), "Anime4K_Upscale_CNN_x2_S.glsl"),
    "medium": (("Anime4K_Restore_CNN_M.glsl",), "Anime4K_Upscale_CNN_x2_M.glsl"),
    "strong": (("Anime4K_Clamp_Highlights.glsl", "Anime4K_Restore_CNN_VL.glsl"), "Anime4K_Upscale_CNN_x2_VL.glsl"),
}
DEFAULT_SHADERS = "medium"
